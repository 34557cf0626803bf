"""License scans by ordered signature rules.

A rule is a keyword with one regex for the words before it and one for those after, a label, a priority and a
confidence.  Texts without any keyword are set aside by a plain substring test; in the rest every place of a keyword
is tested against that keyword's rules only, on a window of words around it, so a place costs the same in a long text
as in a short one.  Detections are intervals of words.  One that lies within another of higher priority, or within a
longer one of the same, is suppressed, first among those of its own place, then among those of the places in reach.

Rules come from a table of licenses (names as regexes over words) times the forms in which texts name them.  Three
phrases are the base: their places are counted whatever suppresses them.  Only SQL functions are used and nothing
shuffles.  Defined cases: a null text counts as empty; a text without words has no places; rows with one doc_id each get
their own row; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words looked at before and after a keyword.
BEFORE, AFTER = 14, 14

BASE = {"mit": "mit", "apache": "apache", "general public": "gpl"}

# Licenses: label, name as it stands before "license", version as a regex or "".  Names are words, punctuation is gone.
LICENSES = [
    ("apache-2.0", "apache(?: software)?", "2(?: 0)?"), ("apache-1.1", "apache(?: software)?", "1 1"), ("apache-1.0", "apache(?: software)?", "1 0"), ("apache", "apache(?: software)?", ""),
    ("mit", "(?:mit|expat|x11)", ""), ("mit-0", "mit no attribution", ""),
    ("gpl-3.0", "(?:gnu )?general public", "3(?: 0)?"), ("gpl-2.0", "(?:gnu )?general public", "2(?: 0)?"), ("gpl-1.0", "(?:gnu )?general public", "1(?: 0)?"), ("gpl", "(?:gnu )?(?:general public|gpl)", ""),
    ("lgpl-3.0", "(?:gnu )?lesser general public", "3(?: 0)?"), ("lgpl-2.1", "(?:gnu )?lesser general public", "2 1"), ("lgpl-2.0", "(?:gnu )?library general public", "2(?: 0)?"), ("lgpl", "(?:gnu )?(?:lesser|library) general public", ""),
    ("agpl-3.0", "(?:gnu )?affero general public", "3(?: 0)?"), ("agpl", "(?:gnu )?affero general public", ""), ("gfdl-1.3", "(?:gnu )?free documentation", "1 3"), ("gfdl", "(?:gnu )?free documentation", ""),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", ""), ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)", ""), ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd)", ""), ("bsd", "(?:bsd|berkeley software distribution)", ""),
    ("mpl-2.0", "mozilla public", "2(?: 0)?"), ("mpl-1.1", "mozilla public", "1 1"), ("mpl", "mozilla public", ""), ("epl-2.0", "eclipse public", "2(?: 0)?"), ("epl-1.0", "eclipse public", "1(?: 0)?"), ("epl", "eclipse public", ""),
    ("isc", "isc", ""), ("artistic-2.0", "artistic", "2(?: 0)?"), ("artistic", "artistic", ""), ("zlib", "(?:zlib|zlib libpng)", ""), ("bsl-1.0", "boost software", "1(?: 0)?"), ("bsl", "boost software", ""), ("unlicense", "unlicense", ""),
    ("wtfpl", "do what the fuck you want to public", ""), ("cddl-1.0", "common development and distribution", "1(?: 0)?"), ("cddl", "common development and distribution", ""), ("eupl-1.2", "european union public", "1 2"), ("eupl", "european union public", ""),
    ("osl-3.0", "open software", "3(?: 0)?"), ("osl", "open software", ""), ("ofl-1.1", "sil open font", "1 1"), ("ofl", "(?:sil )?open font", ""), ("psf-2.0", "python software foundation", "2(?: 0)?"), ("psf", "(?:python software foundation|psf)", ""),
    ("php-3.01", "php", "3 01"), ("php", "php", ""), ("ms-pl", "microsoft public", ""), ("ms-rl", "microsoft reciprocal", ""), ("afl-3.0", "academic free", "3(?: 0)?"), ("afl", "academic free", ""),
    ("odbl", "open database", ""), ("odc-by", "open data commons attribution", ""), ("postgresql", "postgresql", ""), ("ruby", "ruby", ""), ("vim", "vim", ""), ("openssl", "openssl", ""), ("cecill", "cecill", ""), ("upl-1.0", "universal permissive", "1 0"), ("ncsa", "(?:ncsa|university of illinois)(?: open source)?", ""), ("proprietary", "(?:proprietary|commercial|end user)", ""),
]
# Creative Commons parts: label, short words, long words.
CREATIVE = [
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by", "by", "attribution"),
]
# Short forms that stand alone: keyword, version, label.
SHORT = [("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("epl", "epl"), ("gfdl", "gfdl"), ("cddl", "cddl"), ("eupl", "eupl"), ("wtfpl", "wtfpl")]
SPDX = ["mit", "apache 2 0", "gpl 2 0 only", "gpl 3 0 only", "gpl 2 0 or later", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 3 0 or later", "agpl 3 0 only", "bsd 2 clause", "bsd 3 clause", "mpl 2 0", "isc", "unlicense", "zlib", "epl 2 0", "bsl 1 0", "cc0 1 0", "0bsd"]
LICENSE_WORDS = ["license", "licence"]
GRANT = r"(?:released|distributed|published|available|provided|covered|redistributed) under (?:the )?(?:terms of (?:the )?)?"

#: Substrings of lower-cased texts one of which stands in every text with a keyword.
PREFILTER = ["licen", "copyright", "spdx", "creative", "gpl", "cc", "mpl", "epl", "gfdl", "cddl", "eupl", "public domain", "all rights"]


def rules() -> list[tuple[str, str, str, str, int, float, bool]]:
    """(keyword, words before, words after, label, priority, confidence, base) in order."""
    out: list[tuple[str, str, str, str, int, float, bool]] = []
    for words, label in BASE.items():
        out.append(("license", words, "", label, 1, 0.7, True))
    for label, name, version in LICENSES:
        tail = rf"(?: version| v)? ?{version}" if version else ""
        high = 3 if version else 2
        after = rf"(?:version |v ?)?{version}" if version else ""
        for word in LICENSE_WORDS:
            out.append((word, name, after, label, high, 0.85, False))
            out.append((word, GRANT + name, after, label, high + 2, 0.95, False))
            if version:
                out.append((word, rf"{name}(?: v)? ?{version}", "", label, high, 0.8, False))
        for word in ("licensed", "licenced"):
            out.append((word, "", rf"under (?:the )?(?:terms of (?:the )?)?{name} licen[cs]e{tail if tail else ''}", label, high + 2, 0.97, False))
    for label, short, long in CREATIVE:
        for version in ("4 0", "3 0", "2 0", ""):
            name = f"{label}-{version.replace(' ', '.')}" if version else label
            tail, high = f" {version}" if version else "", 3 if version else 2
            out.append(("cc", "", short + tail, name, high + len(short) // 3, 0.9, False))
            out.append(("licensed", "", rf"under (?:the |a )?(?:creative commons |cc ){short}{tail}", name, high + 2 + len(short) // 3, 0.97, False))
            out.append(("commons", "creative", f"{long}{tail}", name, high + len(short) // 3, 0.9, False))
    out += [("cc0", "", "(?:1 0)?", "cc0-1.0", 3, 0.9, False), ("commons", "creative", "(?:zero|0)", "cc0-1.0", 3, 0.9, False), ("domain", "(?:dedicated to the |in the )public", "", "public-domain", 2, 0.6, False)]
    for word, label in SHORT:
        out.append((word, "", "", label, 1, 0.6, False))
        for version, dotted in (("3(?: 0)?", "3.0"), ("2 1", "2.1"), ("2(?: 0)?", "2.0"), ("1 1", "1.1")):
            out.append((word, "", rf"(?:version |v ?)?{version}", f"{label}-{dotted}", 2, 0.75, False))
        out.append(("licensed", "", rf"under (?:the )?{word}", label, 3, 0.9, False))
    for ident in SPDX:
        out.append(("spdx", "", f"licen[cs]e identifier {ident}", ident.replace(" ", "-"), 9, 1.0, False))
    out += [("reserved", "all rights", "", "all-rights-reserved", 1, 0.5, False), ("copyright", "", r"(?:c )?(?:19|20)[0-9][0-9]", "copyright-notice", 1, 0.4, False), ("copyright", "", "", "copyright", 0, 0.3, False)]
    return out


def _rule_map() -> Column:
    by: dict[str, list[Column]] = {}
    for order, (word, before, after, label, priority, confidence, base) in enumerate(rules()):
        left = rf"(?:^| )({before})$" if before else "()$"
        right = rf"^({after})(?: |$)" if after else "^()"
        by.setdefault(word, []).append(F.struct(F.lit(left).alias("l"), F.lit(right).alias("r"), F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(confidence).alias("conf"), F.lit(base).alias("base"), F.lit(order).alias("o")))
    return F.create_map(*[x for word, found in by.items() for x in (F.lit(word), F.array(*found))])


def keywords() -> list[str]:
    return sorted({r[0] for r in rules()})


def _count(c: Column) -> Column:
    """Words in a string of words with one space between."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)


def _detections() -> Column:
    """Of column w (words): for each keyword place the detections there, as arrays of structs."""
    words = F.col("w")

    def place(p: Column) -> Column:
        left = F.array_join(F.slice(words, F.greatest(p - BEFORE, F.lit(0)) + 1, F.least(p, F.lit(BEFORE))), " ")
        right = F.array_join(F.slice(words, p + 2, AFTER), " ")
        context = F.array(F.struct(left.alias("l"), right.alias("r")))  # an array of one, so that both are made once

        def matched(c: Column) -> Column:
            hits = F.filter(F.element_at(F.col("rules"), F.get(words, p)), lambda r: F.rlike(c["l"], r["l"]) & F.rlike(c["r"], r["r"]))
            return F.transform(hits, lambda r: F.struct(
                (p - _count(F.call_function("regexp_extract", c["l"], r["l"], F.lit(1)))).cast("long").alias("start"), (p + 1 + _count(F.call_function("regexp_extract", c["r"], r["r"], F.lit(1)))).cast("long").alias("end"),
                r["label"].alias("label"), r["priority"].alias("priority"), r["conf"].alias("conf"), r["base"].alias("base"), r["o"].alias("o"),
            ))

        return F.flatten(F.transform(context, matched))

    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(F.array(*map(F.lit, keywords())), F.get(words, i)))
    return F.transform(places, place)


def _kept(found: Column, others: Column) -> Column:
    """Detections of one place that none of ``others`` suppresses."""

    def over(e: Column, d: Column) -> Column:
        within = (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (e["o"] != d["o"])
        longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
        return within & ((e["priority"] > d["priority"]) | (e["priority"] == d["priority"]) & (longer | (e["o"] < d["o"])))

    return F.filter(found, lambda d: ~F.exists(others, lambda e: over(e, d)))


def scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, base array<struct>, detections array<struct start, end, label, conf>) for each row; word numbers from 0, end exclusive."""
    docs = documents.select("doc_id", text_or_empty().alias("text"))
    low = F.lower("text")
    hit = low.contains(PREFILTER[0])
    for k in PREFILTER[1:]:
        hit = hit | low.contains(k)
    docs = docs.select("doc_id", F.regexp_count("text", F.lit(RAW_WORD)).cast("long").alias("n_words"), F.when(hit, F.col("text")).alias("text"))
    docs = docs.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0))).alias("w"))
    docs = docs.withColumn("rules", F.when(F.col("w").isNotNull(), _rule_map()))
    docs = docs.withColumn("found", F.when(F.col("w").isNotNull(), _detections())).drop("w", "rules")
    all_found = F.filter(F.flatten("found"), lambda d: d["base"])
    reach = BEFORE + AFTER  # places farther apart than that share no detection
    near = lambda i: F.flatten(F.slice("own", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)))
    docs = docs.withColumn("own", F.transform("found", lambda f: _kept(f, f)))
    kept = F.flatten(F.transform("own", lambda f, i: _kept(f, near(i))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,conf:double>>")
    short = lambda c: F.array_distinct(F.transform(c, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["label"].alias("label"), d["conf"].alias("conf"))))
    return docs.select("doc_id", "n_words", F.coalesce(short(all_found), none).alias("base"), F.coalesce(F.array_sort(short(kept)), none).alias("detections"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    label = lambda c: F.transform(c, lambda d: d["label"])
    starts = F.transform("base", lambda d: d["start"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(label(F.col("base"))).alias("base_labels"), joined(F.concat(label(F.col("base")), label(F.col("detections")))).alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "detections"), lambda d: d["conf"])), F.lit(0.0)).alias("score"),
    )


QUERIES = {"op3_licenses": op3_licenses}
ORACLES: dict[str, str] = {}
