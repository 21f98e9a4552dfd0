"""License scans by ordered signature rules, in DataFrame functions only.

Texts become lower-case words parted by one blank. Three base phrases are counted in all of them.
Signature rules are regular expressions over those words, ordered by priority. A gate of a few
stems, and then one keyword per rule among the text's words, decide which expressions run at all.
A detection whose interval another contains is suppressed (of equal intervals the one of lower
priority); of those that overlap in part, the one of higher priority stays. Labels of what is left
are added to the base phrases' own.

Defined results: a null text is an empty one: no words, no labels (empty strings), null first and
last word, score 0; repeated rows get rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidoc.llm.native import blanks, let, spaced, word_count

#: Phrases and labels of the query's contract. Fixed values.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licences whose acronym and version are enough to name them.
ACRONYMS = ("mpl", "epl", "cddl", "eupl", "osl", "afl", "ofl", "gfdl", "odbl", "busl", "sspl")

INTERVALS = "array<struct<start:int,end:int,priority:int,label:string>>"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Every signature demands one of these; most texts have none and are done.
GATE = (
    "licen", "copyright", "reserved", "public domain", "spdx", "warrant", "redistribution", " cc", "creative", "proprietary", "unauthorized",
    "permission", "noninfringement", "bsd", "apache", "gpl", " mit ", "endorse", "advertising materials", "free documentation",
    *(f" {x} " for x in ACRONYMS),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str  # a word that every match has
    pattern: str  # over words parted by one blank
    priority: int  # 0 to 100; also the confidence in percent


def _number(version: str) -> str:
    """``2.0`` as words; a trailing zero may be left out."""
    major, _, minor = version.partition(".")
    return f"v?{major}" + (f" {minor}" if minor not in ("", "0") else "( 0)?")


def _rules() -> list[Rule]:
    v = "( version| v)? "
    out: list[Rule] = []

    def add(label: str, keyword: str, *patterns: str, priority: int = 80) -> None:
        out.extend(Rule(label, keyword, p, priority) for p in patterns)

    for n in ("1.0", "1.1", "2.0"):
        w = _number(n)
        add(f"apache-{n}", "apache", f"apache( software)? licen[cs]e{v}{w}", f"apache {w}( licen[cs]e)?", f"spdx license identifier apache {w}", priority=95)
    add("apache", "apache", "apache( software)? licen[cs]e", "licensed under( the)? apache", priority=70)
    add("apache-2.0", "apache", "www apache org licenses license 2 0", priority=95)
    for short, name in (("gpl", "gnu general public licen[cs]e"), ("lgpl", "gnu (lesser|library) general public licen[cs]e"), ("agpl", "gnu affero general public licen[cs]e")):
        numbers = {"gpl": ("1.0", "2.0", "3.0"), "lgpl": ("2.0", "2.1", "3.0"), "agpl": ("1.0", "3.0")}[short]
        for n in numbers:
            w = _number(n)
            add(f"{short}-{n}-or-later", "gnu", f"{name}( as published by the free software foundation)?( either)?{v}{w}( of the licen[cs]e)? or( at your option)? any later( version)?", priority=98)
            add(f"{short}-{n}", "gnu", f"{name}( as published by the free software foundation)?( either)?{v}{w}", priority=95)
            add(f"{short}-{n}", short, f"licensed under( the)?( gnu)? {short}{v}{w}", f"spdx license identifier {short} {w}( only)?", priority=95)
            add(f"{short}-{n}-or-later", short, f"spdx license identifier {short} {w} or later", priority=98)
            # the acronym and a version: GPL v3, GPL-2.0-only, LGPLv2.1 or later
            major, minor = n.split(".")
            glued = f"{short}v{major}" + (f" {minor}" if minor != "0" else "( 0)?")
            later = "( and| or)?( at your option)? (any )?later( version)?"
            for keyword, spelled in ((short, f"{short}{v}{w}"), (f"{short}v{major}", glued)):
                add(f"{short}-{n}", keyword, f"(gnu )?{spelled}( only)?", priority=90)
                add(f"{short}-{n}-or-later", keyword, f"(gnu )?{spelled}{later}", priority=93)
        add(f"{short}-unversioned", "gnu", name, priority=70)
        add(f"{short}-unversioned", short, f"licensed under( the)?( gnu)? {short}", f"(released|distributed|available) under( the)?( terms of the)?( gnu)? {short}( licen[cs]e)?", priority=70)
    add("mit", "mit", "(the )?mit licen[cs]e", "(licensed|released|distributed|available) under( the)?( terms of the)? mit", "spdx license identifier mit", "opensource org licenses mit", priority=92)
    add("mit", "copy", "permission is hereby granted free of charge to any person obtaining a copy", priority=92)
    add("mit", "noninfringement", "fitness for a particular purpose and noninfringement", priority=60)
    add("isc", "isc", "isc licen[cs]e", "spdx license identifier isc", priority=90)
    add("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose", priority=90)
    for n, word in ((2, "(2|two)"), (3, "(3|three)"), (4, "(4|four)")):
        add(f"bsd-{n}-clause", "bsd", f"bsd {word} clause( licen[cs]e)?", f"{word} clause bsd( licen[cs]e)?", f"spdx license identifier bsd {n} clause", priority=94)
    add("bsd-0-clause", "bsd", "(bsd 0 clause|zero clause bsd)( licen[cs]e)?", priority=94)
    add("bsd-0-clause", "0bsd", "0bsd( licen[cs]e)?", priority=94)
    add("bsd-3-clause", "bsd", "(new|revised|modified) bsd( licen[cs]e)?", priority=90)
    add("bsd-2-clause", "bsd", "(simplified|freebsd) bsd( licen[cs]e)?", priority=90)
    add("bsd-4-clause", "bsd", "(original|old) bsd( licen[cs]e)?", priority=90)
    add("bsd", "bsd", "bsd( style)? licen[cs]e", "licensed under( the)? bsd", priority=70)
    add("bsd-like", "redistribution", "redistribution and use in source and binary forms( with or without modification)?", priority=75)
    add("bsd-like", "redistributions", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", priority=75)
    add("bsd-3-clause", "endorse", "be used to endorse or promote products derived from this software", priority=80)
    add("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software", priority=80)
    for short, keyword, name, numbers in (
        ("mpl", "mozilla", "mozilla public licen[cs]e", ("1.0", "1.1", "2.0")),
        ("epl", "eclipse", "eclipse public licen[cs]e", ("1.0", "2.0")),
        ("cddl", "development", "common development and distribution licen[cs]e", ("1.0", "1.1")),
        ("cpl", "common", "common public licen[cs]e", ("0.5", "1.0")),
        ("eupl", "union", "european union public licen[cs]e", ("1.0", "1.1", "1.2")),
        ("osl", "open", "open software licen[cs]e", ("1.0", "2.0", "2.1", "3.0")),
        ("afl", "academic", "academic free licen[cs]e", ("1.2", "2.0", "2.1", "3.0")),
        ("artistic", "artistic", "artistic licen[cs]e", ("1.0", "2.0")),
        ("ofl", "sil", "sil open font licen[cs]e", ("1.0", "1.1")),
        ("gfdl", "documentation", "gnu free documentation licen[cs]e", ("1.1", "1.2", "1.3")),
        ("odc-by", "commons", "open data commons attribution licen[cs]e", ("1.0",)),
        ("odbl", "database", "open (data commons )?database licen[cs]e", ("1.0",)),
        ("bsl", "boost", "boost software licen[cs]e", ("1.0",)),
        ("busl", "business", "business source licen[cs]e", ("1.0", "1.1")),
        ("sspl", "side", "server side public licen[cs]e", ("1",)),
        ("elastic", "elastic", "elastic licen[cs]e", ("1.0", "2.0")),
        ("polyform-noncommercial", "polyform", "polyform noncommercial licen[cs]e", ("1.0.0",)),
        ("upl", "permissive", "universal permissive licen[cs]e", ("1.0",)),
        ("ncsa", "ncsa", "university of illinois ncsa open source licen[cs]e", ()),
        ("zlib", "zlib", "zlib( libpng)? licen[cs]e", ()),
        ("php", "php", "php licen[cs]e", ("3.0", "3.01")),
        ("psf", "python", "python software foundation licen[cs]e", ("2.0",)),
        ("wtfpl", "fuck", "do what the fuck you want to public licen[cs]e", ("2",)),
        ("ms-pl", "microsoft", "microsoft public licen[cs]e", ()),
        ("ms-rl", "reciprocal", "microsoft reciprocal licen[cs]e", ()),
        ("cecill", "cecill", "cecill( free software)? licen[cs]e", ("1.0", "2.0", "2.1")),
        ("mulan-psl", "mulan", "mulan permissive software licen[cs]e", ("1.0", "2.0")),
        ("openssl", "openssl", "openssl licen[cs]e", ()),
        ("vim", "vim", "vim licen[cs]e", ()),
        ("ruby", "ruby", "ruby licen[cs]e", ()),
        ("llama-community", "llama", "llama( [0-9]+)*( community)? licen[cs]e", ()),
        ("openrail", "openrail", "(creativeml |bigscience )?openrail( [ms])* licen[cs]e", ()),
    ):
        spdx = short.replace("-", " ")
        for n in numbers:
            words = _number(n) if n.count(".") < 2 else n.replace(".", " ")
            add(f"{short}-{n}", keyword, f"{name}{v}{words}", priority=95)
            add(f"{short}-{n}", spdx.split()[0], f"spdx license identifier {spdx} {words}", f"licensed under( the)? {spdx} {words}", priority=95)
            if short in ACRONYMS:
                add(f"{short}-{n}", short, f"{short}{v}{words}", priority=88)
        add(short, keyword, name, priority=75)
    for code, name in (
        ("by", "attribution"),
        ("by-sa", "attribution share ?alike"),
        ("by-nd", "attribution no ?deriv(ative)?s"),
        ("by-nc", "attribution non ?commercial"),
        ("by-nc-sa", "attribution non ?commercial share ?alike"),
        ("by-nc-nd", "attribution non ?commercial no ?deriv(ative)?s"),
    ):
        short = code.replace("-", " ")
        for n in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"cc-{code}-{n}", "cc", f"cc {short}{v}{_number(n)}", priority=96)
            add(f"cc-{code}-{n}", "creative", f"creative commons {name}( (international|unported|generic))?( public)?( licen[cs]e)?{v}{_number(n)}( (international|unported|generic))?", priority=96)
        add(f"cc-{code}", "cc", f"cc {short}", priority=78)
        add(f"cc-{code}", "creative", f"creative commons {name}", priority=78)
        add(f"cc-{code}", "creativecommons", f"creativecommons org licenses {short}", priority=85)
    add("cc0-1.0", "cc0", "cc0( 1 0)?( universal)?", priority=92)
    add("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", priority=92)
    add("cc-unversioned", "creative", "creative commons( licen[cs]e)?", priority=60)
    add("public-domain", "domain", "(released|placed|dedicated|is) (in|into|to) the public domain", "public domain dedication", priority=80)
    add("unlicense", "unlicense", "(the )?unlicense", priority=85)
    add("unlicense", "unencumbered", "free and unencumbered software released into the public domain", priority=95)
    add("copyright-notice", "copyright", "copyright( c)? (19|20)[0-9]{2}( (19|20)[0-9]{2})*", "copyright c", priority=65)
    add("copyright-notice", "copyrighted", "copyrighted (material|work)s?", priority=55)
    add("proprietary", "proprietary", "proprietary and confidential", "confidential and proprietary", "proprietary (software )?licen[cs]e", priority=80)
    add("proprietary", "unauthorized", "unauthorized (copying|reproduction|distribution|use)( of this (file|document|work))?", priority=75)
    add("proprietary", "permission", "(may not be|no part of this [a-z]+ may be) (reproduced|copied|distributed)[a-z ]{0,80} without( the)?( prior)?( written)? permission", priority=75)
    add("reserved-some", "reserved", "some rights reserved", priority=70)
    add("no-warranty", "warranty", "without (any )?warranty( of any kind)?", priority=50)
    add("no-warranty", "warranties", "without warranties( or conditions)? of any kind", priority=50)
    # What a text denies contains, and so suppresses, the licence that it names.
    add("not-licensed", "not", "not( [a-z]+)? (licensed|released|distributed|available) under( the)?( terms of the)?( [a-z0-9]+){1,6}? licen[cs]e", priority=99)
    add("eula", "agreement", "end user licen[cs]e agreement", priority=80)
    add("royalty-free", "royalty", "royalty free licen[cs]e", priority=60)
    return out


RULES = tuple(_rules())


def word_text(text: Column) -> Column:
    """Words parted by one blank, A-Z in lower case (and other letters too, which no phrase has; the
    two of them that would become ASCII letters are another letter first)."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\xb5")), F.lit("\u0130"), F.lit("\xb5"))
    return spaced(F.lower(kept), NOT_WORD)


def places(padded: Column, n_words: Column, phrase: str) -> Column:
    """How often the phrase's words stand in a text (its words with a blank before and after each),
    and the first and last word where they start."""
    k = len(phrase.split())
    pieces = F.split(padded, f" {phrase}(?= )")  # a piece has a blank before each of its words

    def found(p: Column) -> Column:
        n = F.size(p) - 1
        after = blanks(F.element_at(p, -1)) - 1
        return F.struct(
            n.cast("long").alias("n"),
            F.when(n > 0, blanks(F.element_at(p, 1))).cast("long").alias("first"),
            F.when(n > 0, n_words - after - k).cast("long").alias("last"),
        )

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(padded, F.lit(f" {phrase} ")), let(pieces, found)).otherwise(none)


def hits(padded: Column, rules: Sequence[Rule]) -> Column:
    """The numbers of the rules whose expression matches: a gate of a few stems, then one keyword per
    rule among the text's words, then the expressions, each a literal and so compiled once. Null
    where no gate stem stands."""
    by_keyword: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        by_keyword.setdefault(r.keyword, []).append(k)
    keywords = F.array(*map(F.lit, sorted(by_keyword)))
    none = F.array().cast("array<int>")

    def tried(present: Column) -> Column:
        groups = []
        for word, own in sorted(by_keyword.items()):
            run = F.array_compact(F.array(*[F.when(F.rlike(padded, F.lit(expression(rules[k]))), F.lit(k)) for k in own]))
            groups.append(F.when(F.array_contains(present, word), run).otherwise(none))
        return F.flatten(F.array(*groups))

    gate = None
    for stem in GATE:
        own = F.contains(padded, F.lit(stem))
        gate = own if gate is None else gate | own
    return F.when(gate, let(F.array_intersect(F.split(padded, " "), keywords), tried))


def expression(rule: Rule) -> str:
    return f" {rule.pattern}(?= )"


def intervals(padded: Column, numbers: Column, rules: Sequence[Rule]) -> Column:
    """Every match of the rules ``numbers`` in a text: an array of ``start``, ``end`` (places in
    ``padded``), ``priority`` and ``label``."""
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(expression(r)).alias("pattern")) for r in rules])

    def of_rule(k: Column) -> Column:
        def placed(r: Column) -> Column:
            parts = F.arrays_zip(
                F.transform(F.split(padded, r["pattern"]), lambda x: F.length(x)).alias("gap"),
                F.transform(F.regexp_extract_all(padded, r["pattern"], F.lit(0)), lambda x: F.length(x)).alias("len"),
            )

            def step(a: Column, x: Column) -> Column:
                start = a["at"] + x["gap"]
                own = F.struct(start.alias("start"), (start + x["len"]).alias("end"), r["priority"].alias("priority"), r["label"].alias("label"))
                return F.struct((start + x["len"]).alias("at"), F.concat(a["found"], F.array(own)).alias("found"))

            matched = F.filter(parts, lambda x: x["len"].isNotNull())
            return F.aggregate(matched, F.struct(F.lit(0).alias("at"), F.array().cast(INTERVALS).alias("found")), step, lambda a: a["found"])

        return let(F.get(table, k), placed)

    return F.flatten(F.transform(numbers, of_rule))


def uncontained(found: Column) -> Column:
    """Intervals that no other contains, by start (so by end too); of equal ones the one of highest
    priority, then of the first label."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-x["priority"]).alias("rank"), x["label"].alias("label"))))

    def step(a: Column, x: Column) -> Column:
        end = -x["back"]
        own = F.struct(x["start"].alias("start"), end.alias("end"), (-x["rank"]).alias("priority"), x["label"].alias("label"))
        longer = F.struct(end.alias("end"), F.concat(a["kept"], F.array(own)).alias("kept"))
        return F.when(end > a["end"], longer).otherwise(a)

    return F.aggregate(ordered, F.struct(F.lit(-1).alias("end"), F.array().cast(INTERVALS).alias("kept")), step, lambda a: a["kept"])


def resolved(found: Column) -> Column:
    """What is left of ``uncontained`` intervals when overlaps are resolved: in each run of intervals
    that overlap their neighbours, by priority (then length, then place), an interval is kept if it
    overlaps none that is kept already."""
    one = "array<struct<rank:int,size:int,start:int,end:int,label:string>>"

    def collect(a: Column, x: Column) -> Column:
        own = F.array(F.struct((-x["priority"]).alias("rank"), (x["start"] - x["end"]).alias("size"), x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))
        apart = F.struct(x["end"].alias("end"), F.concat(a["runs"], F.when(F.size(a["run"]) > 0, F.array(a["run"])).otherwise(F.array().cast(f"array<{one}>"))).alias("runs"), own.alias("run"))
        joined = F.struct(x["end"].alias("end"), a["runs"].alias("runs"), F.concat(a["run"], own).alias("run"))
        return F.when(x["start"] >= a["end"], apart).otherwise(joined)

    start = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{one}>").alias("runs"), F.array().cast(one).alias("run"))
    runs = F.aggregate(found, start, collect, lambda a: F.concat(a["runs"], F.array(a["run"])))

    def free(kept: Column, x: Column) -> Column:
        return ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))

    def best(run: Column) -> Column:
        return F.aggregate(F.array_sort(run), F.array().cast(one), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))

    return F.flatten(F.transform(runs, lambda run: F.when(F.size(run) < 2, run).otherwise(best(run))))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    All of it is computed within the row, so nothing is shuffled and no key is needed.
    """
    text = docs.select("doc_id", word_text(F.col("text")).alias("__words"))
    padded = F.concat(F.lit(" "), "__words", F.lit(" "))
    n_words = word_count(F.col("__words"))
    kept = let(hits(padded, rules), lambda k: F.when(F.size(k) > 0, let(intervals(padded, k, rules), lambda x: resolved(uncontained(x)))))
    rows = text.select("doc_id", n_words.alias("n_words"), *[places(padded, n_words, p).alias(f"__p{k}") for k, (p, _) in enumerate(BASE)], kept.alias("__kept"))
    own = F.filter(F.array(*[F.when(F.col(f"__p{k}.n") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    n_base = sum((F.col(f"__p{k}.n") for k in range(1, len(BASE))), F.col("__p0.n"))
    every = range(len(BASE))
    found = F.coalesce(F.col("__kept.label"), F.array().cast("array<string>"))
    surest = -F.array_min(F.col("__kept.rank")) / 100.0
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.least(*[F.col(f"__p{k}.first") for k in every]).alias("first_word"),
        F.greatest(*[F.col(f"__p{k}.last") for k in every]).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(own, found))), ",").alias("labels"),
        F.greatest(F.coalesce(surest, F.lit(0.0)), F.when(n_base > 0, F.lit(0.6)).otherwise(0.0)).cast("double").alias("score"),
    )
