"""License scan by ordered signature rules (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels (fixed by contract).
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: A family's label, the words that name it, and the word without which none of its rules can hold.
FAMILIES = (
    ("agpl-3", "(gnu )?affero general public licen[sc]e( as published by the free software foundation)?( either)?( version| v)? ?3( 0)?", "affero"),
    ("agpl-3", "agpl ?v? ?3( 0)?( only| or later)?", "agpl"),
    ("lgpl-3", "(gnu )?lesser general public licen[sc]e( version| v)? ?3( 0)?", "lesser"),
    ("lgpl-2.1", "(gnu )?lesser general public licen[sc]e( version| v)? ?2 1", "lesser"),
    ("lgpl-2", "(gnu )?library general public licen[sc]e( version| v)? ?2( 0)?", "library"),
    ("lgpl", "(gnu )?lesser general public licen[sc]e", "lesser"),
    ("lgpl", "lgpl ?v? ?(2 1|2 0|2|3 0|3)?( only| or later)?", "lgpl"),
    ("gpl-3", "(gnu )?general public licen[sc]e( version| v)? ?3( 0)?", "general public licen"),
    ("gpl-3", "gpl ?v? ?3( 0)?( only| or later)?", "gpl"),
    ("gpl-2", "(gnu )?general public licen[sc]e( version| v)? ?2( 0)?", "general public licen"),
    ("gpl-2", "gpl ?v? ?2( 0)?( only| or later)?", "gpl"),
    ("gpl", "(gnu )?general public licen[sc]e", "general public licen"),
    ("gfdl", "(gnu )?free documentation licen[sc]e", "documentation"),
    ("apache-2", "apache( software)? licen[sc]e( version| v)? ?2( 0)?", "apache"),
    ("apache-2", "apache 2( 0)?", "apache"),
    ("apache-1.1", "apache( software)? licen[sc]e( version| v)? ?1 1", "apache"),
    ("apache", "apache( software)? licen[sc]e", "apache"),
    ("mit", "(the )?mit licen[sc]e", "mit licen"),
    ("mit", "(the )?expat licen[sc]e", "expat licen"),
    ("mit", "(the )?x11 licen[sc]e", "x11 licen"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("bsd-4", "(bsd 4 clause|4 clause bsd|four clause bsd|original bsd)( licen[sc]e)?", "bsd"),
    ("bsd-3", "(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)( licen[sc]e)?", "bsd"),
    ("bsd-2", "(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)( licen[sc]e)?", "bsd"),
    ("bsd", "bsd( style)? licen[sc]e", "bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution"),
    ("isc", "isc licen[sc]e", "isc"),
    ("mpl-2", "mozilla public licen[sc]e( version| v)? ?2( 0)?", "mozilla"),
    ("mpl-1.1", "mozilla public licen[sc]e( version| v)? ?1 1", "mozilla"),
    ("mpl", "mozilla public licen[sc]e", "mozilla"),
    ("epl-2", "eclipse public licen[sc]e( version| v)? ?2( 0)?", "eclipse"),
    ("epl-1", "eclipse public licen[sc]e( version| v)? ?1( 0)?", "eclipse"),
    ("epl", "eclipse public licen[sc]e", "eclipse"),
    ("cddl", "common development and distribution licen[sc]e", "distribution"),
    ("eupl", "european union public licen[sc]e( v)?( 1)?( [12])?", "european union"),
    ("eupl", "eupl( v)?( 1)?( [12])?", "eupl"),
    ("artistic", "artistic licen[sc]e( 2( 0)?)?", "artistic"),
    ("zlib", "zlib( libpng)? licen[sc]e", "zlib"),
    ("boost", "boost software licen[sc]e( version| v)?( 1 0)?", "boost"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("unlicense", "(the )?unlicen[sc]e", "unlicen"),
    ("openssl", "openssl licen[sc]e", "openssl"),
    ("php", "php licen[sc]e", "php"),
    ("python", "python software foundation licen[sc]e", "python software"),
    ("python", "psf licen[sc]e", "psf licen"),
    ("ofl", "(sil )?open font licen[sc]e( version| v)?( 1 1)?", "font"),
    ("odbl", "open data(base| commons open database) licen[sc]e", "open data"),
    ("cc0", "cc ?0( 1 0)?( universal)?", "cc"),
    ("cc0", "creative commons zero( universal)?", "creative commons zero"),
    ("cc-by-nc-nd", "cc by nc nd( [1-4] [05])?", "cc by nc nd"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(ative|ative work|ative works|atives|s)?( [1-4] [05])?", "creative commons"),
    ("cc-by-nc-sa", "cc by nc sa( [1-4] [05])?", "cc by nc sa"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike( [1-4] [05])?", "creative commons"),
    ("cc-by-nc", "cc by nc( [1-4] [05])?", "cc by nc"),
    ("cc-by-nc", "creative commons attribution non ?commercial( [1-4] [05])?", "creative commons"),
    ("cc-by-nd", "cc by nd( [1-4] [05])?", "cc by nd"),
    ("cc-by-nd", "creative commons attribution no ?deriv(ative|ative work|ative works|atives|s)?( [1-4] [05])?", "creative commons"),
    ("cc-by-sa", "cc by sa( [1-4] [05])?", "cc by sa"),
    ("cc-by-sa", "creative commons attribution share ?alike( [1-4] [05])?", "creative commons"),
    ("cc-by", "cc by( [1-4] [05])?", "cc by"),
    ("cc-by", "creative commons attribution( [1-4] [05])?", "creative commons"),
    ("creative-commons", "creative commons", "commons"),
    ("public-domain", "(released into|dedicated to|placed in|in) the public domain", "public domain"),
    ("proprietary", "proprietary and confidential", "proprietary"),
    ("proprietary", "all rights reserved", "rights reserved"),
)
#: How a family may be invoked: words before its name, and how sure such a mention is.
FORMS = (
    ("spdx license identifier ", 0.99),
    ("(licen[sc]ed|released|distributed|available|published|provided|issued|made available|free software) (under|by|subject to|according to)( the terms of)?( the| a| an)? ", 0.95),
    ("(this|the) (work|software|program|code|file|project|document|text|library|package|material|content) (is|are|may be used)( free software)?( covered by| governed by| subject to| under)( the terms of)?( the| a| an)? ", 0.95),
    ("(see|read|refer to|accept|agree to)( the terms of)?( the| a| an)? ", 0.8),
    ("(terms|conditions|copy|text|version) of( the| a| an)? ", 0.8),
    ("(licen[sc]e|licence) ", 0.7),
    ("", 0.6),
)

#: Short names, which count only after words of ``_CALLS``, also as a later one of several.
SHORT = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("mit", "x11"), ("mit", "expat"), ("isc", "isc"), ("zlib", "zlib( libpng)?"), ("libpng", "libpng( 2 0)?"),
    ("mpl-2", "mpl ?v?2( 0)?"), ("mpl-1.1", "mpl ?v?1 1"), ("mpl", "mpl"), ("epl-2", "epl ?v?2( 0)?"), ("epl-1", "epl ?v?1( 0)?"), ("epl", "epl"),
    ("boost", "bsl( 1 0)?"), ("boost", "boost"), ("ofl", "ofl( 1 [01])?"), ("cddl", "cddl( 1 [01])?"), ("gfdl", "gfdl( 1 [123])?( only| or later)?"),
    ("artistic", "artistic( [12] 0)?"), ("odbl", "odbl( 1 0)?"), ("python", "psf( 2 0)?"), ("python", "python 2 0( 1)?"), ("php", "php( 3 01?)?"), ("openssl", "openssl"),
    ("apache-1.1", "apache 1 1"), ("apache", "apache"), ("gpl", "gpl"), ("agpl", "agpl"), ("bsd-0", "0bsd"), ("bsd", "bsd"), ("ncsa", "ncsa"),
    ("postgresql", "postgresql"), ("ms-pl", "ms pl"), ("afl-3", "afl ?v?3( 0)?"), ("osl-3", "osl ?v?3( 0)?"), ("ecl-2", "ecl 2( 0)?"), ("upl-1", "upl( 1 0)?"),
    ("unlicense", "unlicen[sc]e"), ("public-domain", "public domain"),
)
#: Texts of licenses that do not name themselves, and a keyword of each.
BODIES = (
    ("isc", "permission to use copy modify (and|and or|or) distribute this software( and its documentation)? for any purpose with or without fee is hereby granted", "hereby granted"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted"),
    ("zlib", "in no event will the authors? be held liable for any damages arising from the use of this software", "held liable"),
    ("unlicense", "this is free and unencumbered software", "unencumbered"),
    ("bsd-3", "neither the names? of [^ ]+( [^ ]+){0,12} nor the names of (its|their|the) contributors may be used to endorse", "nor the names of"),
    ("wtfpl", "do what the fuck you want to", "you want to"),
)
_CALLS = (
    "spdx license identifier|licen[sc]e|licen[sc]ed(?: as)?|(?:licen[sc]ed|released|distributed|available|published|provided|issued) under(?: the terms of)?(?: the| an| a)?"
)
_NAME = (
    "mit(?: 0)?|x11|isc|zlib|[al]?gpl(?: v?[23](?: [01])?)?(?: only| or later)?|apache(?: software)?(?: licen[sc]e)?(?: version)?(?: v?[12](?: [01])?)?|0?bsd(?: [0-4] clause)?"
    "|[me]pl(?: v?[12](?: [01])?)?|bsl(?: 1 0)?|boost|unlicen[sc]e|cc0(?: 1 0)?|artistic(?: [12] 0)?|cddl(?: 1 [01])?"
)

#: Words one of which every rule needs; documents without them skip the rules.
_GATE = (
    "(?i)licen[sc]e|(a|l)?gpl|apache|bsd|eupl|wtfpl|creative[^0-9a-z]+commons|cc[^0-9a-z]*0|cc[^0-9a-z]+by"
    "|public[^0-9a-z]+domain|rights[^0-9a-z]+reserved|proprietary|redistribution|hereby[^0-9a-z]+granted"
    "|(released|distributed|available|published|provided|issued)[^0-9a-z]+under[^0-9a-z]"
    "|held[^0-9a-z]+liable|unencumbered|nor[^0-9a-z]+the[^0-9a-z]+names|you[^0-9a-z]+want[^0-9a-z]+to"
)
#: Matches of a rule that are listed together.
_BLOCK = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, pattern, sureness): every family in every form, surest forms first, then
    short names after words that call for one, then license texts."""
    found = [(fam[0], fam[2], f"(?<= ){form}{fam[1]}(?= )", sure) for form, sure in FORMS for fam in FAMILIES]
    # A short name's match is the name alone, so that one name of several does not cover another.
    other = f"(?:(?:{_NAME}) (?:(?:or|and|with) (?:the )?)?)?"
    before = f"(?<= (?:{_CALLS}) {other}{other})"
    for label, name in SHORT:
        plain = name.split("(")[0].split("[")[0].split("?")[0].rstrip()
        found.append((label, f" {plain}", f"(?<= )(?={name} ){before}{name}(?= )", 0.9))
    found += [(label, key, f"(?<= ){text}(?= )", 0.9) for label, text, key in BODIES]
    return [(k, *rule) for k, rule in enumerate(found)]


def _normal(text: Column) -> Column:
    """Words of the lower-cased text, one blank between them and at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _BREAK, " ")), F.lit(" "))



def _places(doubled: Column, total: Column, phrase: str) -> Column:
    """(count, first, last) of a phrase's places in a doubled text, words from 0."""
    n = len(phrase.split())
    parts = F.split(doubled, " " + "  ".join(phrase.split()) + " ", -1)
    blanks = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))
    found = F.size(parts) > 1
    return F.struct(
        (F.size(parts) - 1).cast("long").alias("n"),
        F.when(found, (blanks(parts[0]) / 2).cast("long")).alias("first"),
        F.when(found, (total - blanks(F.element_at(parts, -1)) / 2 - n).cast("long")).alias("last"),
    )


def _detections(normal: Column) -> Column:
    """Array of (start, minus end, priority, label, sure): every match of every rule whose keyword occurs."""
    table = F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(label).alias("label"), F.lit(key).alias("key"), F.lit(pat).alias("pat"), F.lit(sure).alias("sure"))
        for p, label, key, pat, sure in rules()
    ])

    none = F.array().cast("array<struct<s:int,e:int,p:int,label:string,sure:double>>")

    def matches(r: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.char_length(x["gap"])
            return F.struct(
                (begin + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"),
                F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
                    begin.alias("s"), (-(begin + F.char_length(x["hit"]))).alias("e"),
                    r["p"].alias("p"), r["label"].alias("label"), r["sure"].cast("double").alias("sure"),
                )))).alias("out"),
            )

        def walk(pairs: Column) -> Column:
            # Appending copies a list, so matches are listed in blocks and blocks are appended.
            def block(acc: Column, b: Column) -> Column:
                own = F.aggregate(F.slice(pairs, b * _BLOCK + 1, _BLOCK), F.struct(acc["at"].alias("at"), none.alias("out")), step)
                return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))[0]

            blocks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int"))
            return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])

        hits = F.regexp_extract_all(normal, F.concat(F.lit("("), r["pat"], F.lit(")")), F.lit(1))
        # A transform of one element names a value, which would be computed anew wherever it is used.
        zipped = lambda hit: F.array(F.arrays_zip(F.split(normal, r["pat"], -1).alias("gap"), hit.alias("hit")))
        return F.transform(F.array(hits), lambda hit: F.when(F.size(hit) > 0, F.transform(zipped(hit), walk)[0]).otherwise(none))[0]

    return F.flatten(F.transform(F.filter(table, lambda r: F.contains(normal, r["key"])), matches))


def _survivors(detections: Column) -> Column:
    """Labels and the best sureness of detections that no wider or earlier-ranked one covers.

    In order of start, then wider, then priority, a detection is covered exactly if an earlier one
    reaches at least as far.
    """
    return F.aggregate(
        F.array_sort(detections),
        F.struct(F.lit(-1).alias("end"), F.lit(0.0).alias("sure"), F.array().cast("array<string>").alias("labels")),
        lambda acc, d: F.when(-d["e"] <= acc["end"], acc).otherwise(F.struct(
            (-d["e"]).alias("end"), F.greatest(acc["sure"], d["sure"]).alias("sure"),
            F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
        )),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of the base phrases, labels and a score from 0 to 1.

    Columns ``doc_id n_words n_base first_word last_word base_labels labels score``. ``base_labels``
    come from the base phrases alone, ``labels`` add those of the surviving rule matches; both are
    distinct, sorted and comma-joined, empty without any. ``score`` is the sureness of the surest
    match, 0 without one. Null and empty texts have no words and null places. Repeated rows each
    come back, other columns are not read, an empty table gives no rows. Nothing is shuffled.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    empty = F.struct(F.lit(-1).alias("end"), F.lit(0.0).alias("sure"), F.array().cast("array<string>").alias("labels"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text")).select(
        "doc_id", F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(_GATE), _normal(F.col("text"))).alias("normal"),
    )
    doubled = F.replace(F.col("normal"), F.lit(" "), F.lit("  "))
    doubled = F.substring(doubled, F.lit(2), F.char_length(doubled) - 2)
    places = [F.when(F.col("normal").isNull(), none).otherwise(_places(doubled, F.col("n_words"), p)).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    found = F.when(F.col("normal").isNull(), empty).otherwise(_survivors(_detections(F.col("normal"))))
    rows = rows.select("doc_id", "n_words", *places, found.alias("found"))
    base = F.filter(
        F.array(*[F.when(F.col(f"p{k}.n") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]),
        lambda x: x.isNotNull(),
    )
    ends = lambda f, name: f(*[F.col(f"p{k}.{name}") for k in range(len(PHRASES))])
    any_base = F.size(base) > 0
    return rows.select(
        "doc_id", "n_words", sum((F.col(f"p{k}.n") for k in range(len(PHRASES))), F.lit(0)).cast("long").alias("n_base"),
        ends(F.least, "first").alias("first_word"), ends(F.greatest, "last").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.col("found.labels")))), ",").alias("labels"),
        F.when(any_base, F.greatest(F.lit(0.9), F.col("found.sure"))).otherwise(F.col("found.sure")).alias("score"),
    )
