"""Licence recognition by sentences: known sentences become identifiers, sequences of identifiers meet ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.registry import query

# Normalised licence sentences and the identifiers they stand for.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "this project is licensed under the mit license": "MITref",
    "spdx license identifier mit": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "licensed under the apache license version 2 0": "APACHE2ref",
    "licensed under the apache license version 2 0 the license": "APACHE2ref",
    "spdx license identifier apache 2 0": "APACHE2ref",
    "you may not use this file except in compliance with the license": "APACHE2use",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "spdx license identifier gpl 3 0 only": "GPL3ref",
    "spdx license identifier gpl 3 0 or later": "GPL3ref",
    "licensed under the gnu general public license version 2": "GPL2ref",
    "spdx license identifier gpl 2 0 only": "GPL2ref",
    "licensed under cc by nc 4 0": "CCBYNC4ref",
    "licensed under cc by 4 0": "CCBY4ref",
    "licensed under cc by sa 4 0": "CCBYSA4ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "all rights reserved": "RIGHTS",
}
# Identifier sequences in the order in which they are tried; a rule may match several times.
RULES = [
    ("MIT", "MITgrant,MITnotice,MITasis,"),
    ("MIT", "MITref,"),
    ("Apache-2.0", "APACHE2ref,(APACHE2use,)?"),
    ("GPL-3.0", "GPL3ref,"),
    ("GPL-2.0", "GPL2ref,"),
    ("CC-BY-NC-4.0", "CCBYNC4ref,"),
    ("CC-BY-SA-4.0", "CCBYSA4ref,"),
    ("CC-BY-4.0", "CCBY4ref,"),
    ("BSD-2-Clause", "BSDgrant,BSDsource,BSDbinary,"),
    ("proprietary", "RIGHTS,"),
]


# The clause that makes two-clause BSD three-clause; it names the holder.
BSD3_CLAUSE = ("neither the names? of [a-z0-9 ]{1,120}?(?:n?or|and) the names of (?:(?:its|their|the|any|other) )*contributors may be used to endorse or promote "
               "products derived from this software without (?:specific )?prior written permission")
BSD3 = "BSDgrant,BSDsource,BSDbinary,BSDname,"
# What may not follow a sentence: MIT-0 and others of that name, and version 2.1 after 2.
UNLIKE = {"spdx license identifier mit": "0|cmu|feh|modern|advertising|enna|festival|wu",
          "licensed under the gnu general public license version 2": "[1-9]"}
CUE = "licens|copyright|permi|warrant|rights reserved|redistribution"


def identifiers(text: str = "text") -> Column:
    """The known sentences of a text, as identifiers in text order.

    Texts with a cue word of the table are normalised: comment marks and other signs become spaces, so do single
    line breaks; a blank line, and ``.``, ``!``, ``?`` or ``;`` before white space, stay as ``|``. A known sentence
    is found as a run of whole words between two of these, wrapped or not and whatever stands around it, except
    behind ``not``; the one that starts first counts, of these the longest.
    """
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    each = [s + (f"(?! (?:{UNLIKE[s]}) )" if s in UNLIKE else "") for s in sorted(SENTENCES, key=len, reverse=True)]
    pattern = f"(?<= )(?<! not )(?:{'|'.join([BSD3_CLAUSE, *each])})(?= )"
    ends = F.regexp_replace(F.lower(F.col(text)), r"[.!?;]\s+|\r?\n[^a-z0-9\n]*\n", "\u0001")
    plain = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(ends, "[^a-z0-9\u0001]+", " "), " ?\u0001 ?", " | "), F.lit(" "))
    found = F.regexp_extract_all(plain, F.lit(pattern), F.lit(0))
    named = F.transform(found, lambda s: F.coalesce(F.try_element_at(known, s), F.lit("BSDname")))
    return F.coalesce(F.when(F.lower(F.col(text)).rlike(CUE), named), F.array().cast("array<string>"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (comma-joined, in order), ``licenses`` (comma-joined, in rule order, BSD-3-Clause last) and ``n_sentences``.

    Null and empty texts have none of either. Row by row, no shuffle; repeated rows give repeated results.
    """
    ids = F.array_join(F.transform(F.col("__ids"), lambda x: F.concat(x, F.lit(","))), "")
    ids_, three = F.col("sentence_ids"), "(^|,)" + BSD3
    # a three-clause text is not the two-clause licence that it begins with
    two = F.regexp_replace(ids_, three, "$1")
    found = F.array(*[F.when((two if name == "BSD-2-Clause" else ids_).rlike("(^|,)" + rule), F.lit(name)) for name, rule in RULES],
                    F.when(ids_.rlike(three), F.lit("BSD-3-Clause")))
    return (docs.withColumn("__ids", identifiers(text)).withColumn("sentence_ids", ids)
            .withColumn("n_sentences", F.size("__ids").cast("long"))
            .withColumn("licenses", F.array_join(F.array_distinct(F.array_compact(found)), ",")).drop("__ids"))


def _oracle() -> str:
    case = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items())
    rules = ", ".join(f"CASE WHEN regexp_matches(i, '(^|,){r}') THEN '{n}' END" for n, r in RULES)
    return f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(
    string_split(regexp_replace(lower(text), '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)),
    lambda x: CASE trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) {case} END), lambda x: x IS NOT NULL) AS l FROM documents),
j AS (SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_sentences,
             coalesce(array_to_string(list_transform(l, lambda x: x || ','), ''), '') AS i FROM s),
r AS (SELECT *, list_filter([{rules}], lambda x: x IS NOT NULL) AS f FROM j)
SELECT doc_id, i AS sentence_ids, n_sentences,
       coalesce(array_to_string(list_transform(list_filter(range(1, len(f) + 1), lambda k: list_position(f, f[k]) = k), lambda k: f[k]), ','), '') AS licenses
FROM r"""


@query("op9_licenses", _oracle())
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "sentence_ids", "n_sentences", "licenses")
