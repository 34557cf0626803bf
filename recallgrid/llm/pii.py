"""Personal data: base patterns, and bootstrapped contextual extraction.

The base finds e-mail and IP addresses, card and phone numbers by pattern and check.  Bootstrapping goes on from
there: base spans and strings shaped like secrets are the seeds, the two words before an identifier are a lexical pattern,
and patterns and identifiers form a graph.  Spark scores the graph in rounds: a pattern's confidence is the smoothed
share of its identifiers' scores, of one kind; an identifier's score is the noisy-or of its confident patterns.  Identifiers
without a kind that stand behind a confident pattern are new spans, "found_" and the pattern's kind.

Only SQL functions are used.  Offsets are code points, end exclusive.  Places are sums over what stands between matches,
made in blocks, and overlaps come from sorted places, so a text with many identifiers costs little more than their number.  Spans and candidates, without texts, are written to
the checkpoint folder; edges are summed before they join, and a hot pattern meets one row of scores.  Defined cases: a null
text counts as empty and stays null when masked; rows with one doc_id are told apart by text, equal rows have equal spans;
other columns of the input are ignored by ``spans`` and kept by ``mask``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, row_key, table, text_or_empty

# Each pattern finds what the plain form in its comment finds, leftmost and without overlap, in time linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # local@part(.part)+
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",  # four numbers with dots between
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # digits, single spaces or hyphens between; 14 at least
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",  # plus and digits with what stands between them
}
KINDS = [*PATTERNS, "secret", "found_email", "found_ip", "found_card", "found_phone", "found_secret"]
#: Identifier-like strings: six characters or more, one of them a digit, between white space.
CANDIDATE = r"(?<!\S)(?=[^\s0-9]*+[0-9])\S{6,}+"
SECRET = r"^(?:(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}|(?:AKIA|ghp_|gho_|sk-|xoxb-|xoxp-)[A-Za-z0-9_-]{12,})$"
#: Characters before an identifier in which its two words of context are looked for.
CONTEXT = 80
#: So many matches and what stands before them are at least CONTEXT characters: no match has under four.
NEAR_MATCHES = 20
#: Values combined by one array that grows, and characters of a text masked at a time.
BLOCK, PART = 64, 2048
ROUNDS = 3
#: A pattern is confident with this share of one kind and so many distinct seeds' worth of score.
CONFIDENCE, SUPPORT = 0.75, 3.0


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once."""
    return F.transform(F.array(value), then)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each of ``values``, all before it and itself combined.

    Blocks of BLOCK values are combined each on its own and then with what is before the block, so arrays grow by copy
    only within a block, and once more over the blocks.
    """

    def grown(x: Column) -> Column:
        return F.slice(F.aggregate(x, F.array(zero), lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v)))), 2, F.size(x))

    def joined(inner: Column) -> Column:
        heads = F.concat(F.array(zero), grown(F.transform(inner, lambda x: F.element_at(x, -1))))
        return _let(heads, lambda h: F.flatten(F.transform(inner, lambda x, i: F.transform(x, lambda v: combine(h[i], v)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))
    return F.when(F.size(values) > 0, _let(F.transform(blocks, grown), joined)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column) -> Column:
    return _running(values, lambda a, b: a + b, F.lit(0))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s, before>> of the leftmost matches, from what stands between them.

    before: the CONTEXT characters before a match, from the ends of the last NEAR_MATCHES matches and what stands between.
    """
    end = lambda s: F.right(s, F.lit(CONTEXT))

    def made(x: Column) -> Column:
        place = lambda ends, pieces: F.transform(x, lambda p, i: F.struct((ends[i] - F.length(p["f"])).alias("start"), ends[i].alias("end"), p["f"].alias("s"), end(F.concat(_before(pieces, i), end(p["b"]))).alias("before")))
        ends = _sum(F.transform(x, lambda p: F.length(p["b"]) + F.length(p["f"])))
        return _let(ends, lambda e: _let(F.transform(x, lambda p: F.concat(end(p["b"]), end(p["f"]))), lambda pieces: place(e, pieces)))

    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(between.alias("b"), found.alias("f")), lambda x: x["f"].isNotNull())
    return _let(pairs, made)


def _before(pieces: Column, i: Column) -> Column:
    """The NEAR_MATCHES pieces before number i as one string."""
    first = F.greatest(i - NEAR_MATCHES, F.lit(0))
    return F.array_join(F.slice(pieces, first + 1, i - first), "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.rlike(s, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}"))
    digits = F.regexp_replace(s, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits) <= 19, _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _context(before: Column) -> Column:
    """The last two words before an identifier, lower-cased."""
    words = F.regexp_extract(before, r"((?:\S{1,60}\s+)?\S{1,60})\s*$", 1)
    return F.nullif(F.lower(F.regexp_replace(words, r"\s+", " ")), F.lit(""))


def base_and_candidates(documents: DataFrame) -> DataFrame:
    """(doc_id, __r, base, seeds, cands): base array<struct start, end, kind>, seeds and cands array<struct start, end, s, kind, ctx>."""
    docs = documents.select("doc_id", row_key("doc_id", "text").alias("__r"), text_or_empty().alias("text"))
    some = F.when(F.rlike("text", F.lit("[0-9@]")), F.col("text"))
    docs = docs.select("doc_id", "__r", some.alias("t"))
    gate = {"email": F.col("t").contains("@"), "ip": F.col("t").contains("."), "phone": F.col("t").contains("+"), "card": F.rlike("t", F.lit("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"))}
    docs = docs.select("*", *[F.when(gate[k], _matches(F.col("t"), p)).alias(k) for k, p in PATTERNS.items()], _matches(F.col("t"), CANDIDATE).alias("c"))
    typed = lambda k: F.transform(F.filter(k, lambda x: _valid(k, x["s"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), F.lit(k).alias("kind"), _context(x["before"]).alias("ctx")))
    none = F.array().cast("array<struct<start:int,end:int,s:string,kind:string,ctx:string>>")
    docs = docs.withColumn("b", F.concat(*[F.coalesce(typed(k), none) for k in PATTERNS]))
    # punctuation around an identifier is not part of it, but of its context
    lead = lambda s: F.regexp_extract(s, r"^[^A-Za-z0-9+]*", 0)
    bare = lambda s: F.regexp_replace(s, r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
    kind = lambda s: F.when(F.rlike(s, F.lit(SECRET)), "secret")

    def whole(x: Column) -> Column:
        start, s = x["start"] + F.length(lead(x["s"])), bare(x["s"])
        return F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"), kind(s).alias("kind"), _context(F.right(F.concat(x["before"], lead(x["s"])), F.lit(CONTEXT))).alias("ctx"))

    docs = docs.withColumn("c", F.filter(F.transform("c", whole), lambda x: F.length(x["s"]) >= 6))
    free = _let(_covered(F.col("c"), F.col("b")), lambda covered: F.filter("c", lambda x, i: ~covered[i]))
    return docs.select(
        "doc_id", "__r", F.transform("b", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias("base"),
        F.transform("b", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["ctx"].alias("ctx"))).alias("seeds"), free.alias("cands"),
    )


def _covered(cands: Column, base: Column) -> Column:
    """Whether each of ``cands`` (in order of place) overlaps one of ``base``: more base spans have begun before its end than ended by its start."""

    def count(field: str, of: str, ties: int) -> Column:
        marks = F.transform(base, lambda x: F.struct(x[field].alias("p"), F.lit(1 - ties).alias("o"), F.lit(1).alias("n"), F.lit(-1).alias("i")))
        asked = F.transform(cands, lambda x, i: F.struct(x[of].alias("p"), F.lit(ties).alias("o"), F.lit(0).alias("n"), i.alias("i")))
        sums = lambda z: _let(_sum(F.transform(z, lambda m: m["n"])), lambda c: F.transform(z, lambda m, k: F.struct(m["i"].alias("i"), c[k].alias("c"))))
        return F.transform(F.sort_array(F.filter(_let(F.sort_array(F.concat(marks, asked)), sums), lambda m: m["i"] >= 0)), lambda m: m["c"])

    begun, ended = count("start", "end", 0), count("end", "start", 1)
    return F.when(F.size(base) > 0, F.zip_with(begun, ended, lambda x, y: x > y)).otherwise(F.transform(cands, lambda _: F.lit(False)))


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """(ctx, kind, conf) from edges (ctx, s, kind); kind: a seed's, else null."""
    edges = cut(edges.groupBy("ctx", "s").agg(F.max("kind").alias("seed")))
    scores = edges.groupBy("s").agg(F.max("seed").alias("kind")).select("s", "kind", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    seeds = cut(scores)
    scores, found = seeds, None
    for i in range(rounds):
        met = edges.select("ctx", "s").join(scores, "s")
        by_kind = met.groupBy("ctx", "kind").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"))
        total = by_kind.groupBy("ctx").agg(F.sum("n").alias("n"), F.max(F.struct(F.when(F.col("kind").isNotNull(), F.col("mass")).otherwise(0.0).alias("mass"), "kind")).alias("top"))
        found = total.select("ctx", "top.kind", (F.col("top.mass") / (F.col("n") + 1)).alias("conf"), F.col("top.mass").alias("mass"))
        found = cut(found.where((F.col("conf") >= confidence) & (F.col("mass") >= support) & F.col("kind").isNotNull()).select("ctx", "kind", "conf"))
        if i + 1 < rounds:
            # an identifier without a kind gets the kind of its best pattern and the noisy-or of all of them
            through = edges.join(found, "ctx").groupBy("s").agg(F.max(F.struct("conf", "kind"))["kind"].alias("k"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))))).alias("p"))
            scores = cut(seeds.join(through, "s", "left").select("s", F.coalesce("kind", "k").alias("kind"), F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.coalesce("p", F.lit(0.0))).alias("score")))
    return found


def spans(documents: DataFrame) -> DataFrame:
    """(doc_id, __r, base, more) for each row: arrays of struct start, end, kind."""
    rows = cut(base_and_candidates(documents))
    cands = rows.select("doc_id", "__r", F.explode("cands").alias("x")).select("doc_id", "__r", "x.*")
    seeds = rows.select(F.explode("seeds").alias("x")).select("x.*")
    edges = cands.select("ctx", "s", "kind").unionAll(seeds.select("ctx", "s", "kind")).where("ctx is not null")
    patterns = confident_patterns(edges).select("ctx", F.col("kind").alias("__k"))
    new = cands.where("kind is null").join(patterns, "ctx").select("doc_id", "__r", "start", "end", F.concat(F.lit("found_"), "__k").alias("kind"))
    by_doc = new.groupBy("doc_id", "__r").agg(F.collect_set(F.struct("start", "end", "kind")).alias("new"))
    by_doc = by_doc.withColumnsRenamed({"doc_id": "__d", "__r": "__q"})
    secrets = F.transform(F.filter("cands", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    joined = rows.join(by_doc, (F.col("__r") == F.col("__q")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    return joined.select("doc_id", "__r", F.coalesce("base", none).alias("base"), F.concat(F.coalesce(secrets, none), F.coalesce("new", none)).alias("more"))


def in_order(found: Column) -> Column:
    """Spans by start, then kind as listed."""
    number = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.element_at(number, x["kind"]).alias("n"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def written(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(in_order(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def mask(documents: DataFrame) -> DataFrame:
    """``documents`` with each span of text replaced by its kind in brackets; overlapping spans are replaced together."""
    found = spans(documents).where((F.size("base") > 0) | (F.size("more") > 0)).select(F.col("doc_id").alias("__d"), F.col("__r").alias("__q"), in_order(F.concat("base", "more")).alias("__s")).distinct()
    docs = documents.withColumn("__r", row_key("doc_id", "text"))
    joined = docs.join(found, (F.col("__r") == F.col("__q")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left")
    # spans without what an earlier one covers; those that begin inside one have no label of their own
    label = lambda x: F.concat(F.lit("["), F.upper(F.regexp_replace(x["kind"], "^found_", "")), F.lit("]"))
    before = lambda e, i: F.when(i > 0, e[i - 1]).otherwise(0)
    apart = lambda e: F.transform("__s", lambda x, i: F.struct(F.greatest(x["start"], before(e, i)).alias("start"), F.greatest(x["end"], before(e, i)).alias("end"), F.when(x["start"] >= before(e, i), label(x)).otherwise("").alias("label")))
    clear = _let(_running(F.transform("__s", lambda x: x["end"]), F.greatest, F.lit(0)), apart)

    def masked_part(part: Column, low: Column, found: Column) -> Column:
        """A part of the text from place ``low`` on with the spans that touch it."""
        high = low + F.length(part)
        own = F.filter(found, lambda x: (x["end"] > low) & (x["start"] < high))
        start = F.struct(low.alias("at"), F.lit("").alias("out"))
        step = lambda acc, x: F.struct(
            F.least(x["end"], high).alias("at"),
            F.concat(acc["out"], F.substring(part, acc["at"] - low + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.when(x["start"] >= low, x["label"]).otherwise("")).alias("out"),
        )
        return F.aggregate(own, start, step, lambda a: F.concat(a["out"], F.substring(part, a["at"] - low + 1, F.length(part))))

    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    masked = _let(clear, lambda found: F.array_join(F.transform(parts, lambda part, i: masked_part(part, i * PART, found)), ""))
    return joined.select(*[F.when(F.col("__s").isNotNull(), masked).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in documents.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "more")).alias("spans"), F.size(F.concat("base", "more")).cast("long").alias("n_spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
