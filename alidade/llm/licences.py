"""Licence scans: normalised sentences become identifiers, identifier sequences are matched against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alidade.llm.common import documents, let

#: Known licence sentences, normalised (fixed values): identifier -> wordings.
SENTENCES = {
    "mit_short": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "this software is released under the mit license", "distributed under the mit license"],
    "mit_title": ["the mit license", "mit license", "the mit license mit"],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_disclaim": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "isc_grant": [
        "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "apache2_short": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license", "released under the apache license version 2.0", "this project is licensed under the apache license version 2.0"],
    "apache2_comply": ["you may not use this file except in compliance with the license"],
    "apache2_obtain": ["you may obtain a copy of the license at"],
    "apache2_as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd_endorse": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl3_short": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is licensed under the gnu general public license version 3", "released under the gnu general public license version 3"],
    "gpl2_short": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl_free": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_free": ["this program is free software you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "cc_by_nc_4": ["licensed under cc by-nc 4.0", "this work is licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc_by_sa_4": ["licensed under cc by-sa 4.0", "this work is licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc_by_4": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc0": ["licensed under cc0 1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "mpl2": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: Ordered rules (fixed values): (licence, sentence identifiers in order). Each takes its sentences away from later ones.
RULES = [
    ("MIT", ["mit_title", "mit_grant", "mit_notice", "mit_disclaim"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_disclaim"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("Apache-2.0", ["apache2_short", "apache2_comply", "apache2_obtain", "apache2_as_is"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("ISC", ["isc_grant"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_short"]),
    ("MIT", ["mit_title"]),
    ("Apache-2.0", ["apache2_short"]),
    ("GPL-3.0-only", ["gpl3_short"]),
    ("GPL-2.0-only", ["gpl2_short"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_4"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_4"]),
    ("CC-BY-4.0", ["cc_by_4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2"]),
    ("Unlicense", ["unlicense"]),
]

#: Every known sentence holds one of these; a text without any holds no known sentence.
HINTS = ("licen", "permi", "warrant", "redistribut", "public domain", "copy", "under")
BREAK = r"[.!?:](\s+|$)|[\r\n]+"
WRAPPED = r"[.!?:](\s+|$)|\n\s*\n"
NOT_NORMAL = r"[^a-z0-9./+-]+"


def normal(sentence: Column) -> Column:
    """Lower case, runs of other characters to one blank, no blanks or punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(sentence), NOT_NORMAL, " "), r"^[ ./+-]+|[ ./+-]+$", "")


def _identified(text: Column, pattern: str) -> Column:
    """The text's known sentence identifiers in order, each in angle brackets; others leave a '#', runs of them one."""
    known = {w: i for i, ws in SENTENCES.items() for w in ws}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    marks = F.transform(F.split(text, pattern), lambda s: F.when(s.rlike(r"[A-Za-z]"), F.coalesce(F.concat(F.lit("<"), F.element_at(table, normal(s)), F.lit(">")), F.lit("#"))).otherwise(F.lit("")))
    return F.regexp_replace(F.array_join(marks, ""), "#+", "#")


def _matched(ids: Column) -> Column:
    """Licences whose rules match the identifier sequence; a rule's sentences are used up before later rules."""

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["ids"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["ids"], F.lit("#"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["licence"])).otherwise(state["found"]).alias("found"),
        )

    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit("".join(f"<{s}>" for s in seq)).alias("ids")) for name, seq in RULES])
    start = F.struct(ids.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(rules, start, step, lambda a: a["found"])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with sentence_ids, wrapped_ids, licences (sorted, comma-joined) and n_known.

    A text is cut into sentences twice, with line ends as breaks (sentence_ids) and as blanks (wrapped_ids, for
    sentences broken over lines), and the rules read both sequences. Sentences of a rule must follow each other with
    none between. n_known counts the identifiers of the first sequence. Null or empty texts, and texts without a
    known sentence, have empty ids and no licence. Rows are scanned alone; input columns named like a result are
    replaced. Built-in functions only; the sentence and rule tables are literals of fixed size.
    """
    out = ["sentence_ids", "wrapped_ids", "licences", "n_known"]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    folded = F.lower(t)
    hinted = F.lit(False)
    for h in HINTS:
        hinted = hinted | F.contains(folded, F.lit(h))
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out], F.when(hinted, t).otherwise(F.lit("")).alias("__text"))

    def known_only(ids: Column) -> Column:
        return let(ids, lambda x: F.when(F.contains(x, F.lit("<")), x).otherwise(F.lit("")))

    rows = rows.withColumns({"sentence_ids": known_only(_identified(F.col("__text"), BREAK)), "wrapped_ids": known_only(_identified(F.col("__text"), WRAPPED))})
    found = F.array_union(_matched(F.col("sentence_ids")), _matched(F.col("wrapped_ids")))
    return rows.withColumns(
        {
            "licences": F.array_join(F.array_sort(found), ","),
            "n_known": (F.length("sentence_ids") - F.length(F.replace(F.col("sentence_ids"), F.lit("<"), F.lit("")))).cast("long"),
        }
    ).drop("__text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def _sql() -> str:
    pairs = ", ".join(f"('{w}', '{i}')" for i, ws in SENTENCES.items() for w in ws)
    ids = "string_agg(CASE WHEN NOT regexp_matches(s, '[A-Za-z]') THEN '' ELSE coalesce('<' || k.id || '>', '#') END, '' ORDER BY p)"
    cuts = "\n".join(
        f""", {name} AS (SELECT rid, regexp_replace({ids}, '#+', '#', 'g') AS ids FROM
    (SELECT rid, unnest(parts) AS s, unnest(range(len(parts))) AS p FROM (SELECT rid, regexp_split_to_array(t, '{cut}') AS parts FROM d))
    LEFT JOIN known k ON k.w = regexp_replace(regexp_replace(lower(s), '[^a-z0-9./+-]+', ' ', 'g'), '^[ ./+-]+|[ ./+-]+$', '', 'g') GROUP BY rid)"""
        for name, cut in (("a", r"[.!?:](\s+|$)|[\r\n]+"), ("b", r"[.!?:](\s+|$)|\n\s*\n"))
    )
    rules = ", ".join(f"({k}, '{name}', '{''.join(f'<{s}>' for s in seq)}')" for k, (name, seq) in enumerate(RULES))
    return rf"""
WITH RECURSIVE known(w, id) AS (VALUES {pairs}), rules(k, licence, ids) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents)
{cuts}
, seqs AS (SELECT rid, 1 AS v, CASE WHEN contains(ids, '<') THEN ids ELSE '' END AS ids FROM a
           UNION ALL SELECT rid, 2, CASE WHEN contains(ids, '<') THEN ids ELSE '' END FROM b),
steps AS (SELECT rid, v, 0 AS k, ids AS rest, CAST([] AS VARCHAR[]) AS found FROM seqs WHERE ids <> ''
  UNION ALL SELECT rid, v, s.k + 1, CASE WHEN contains(rest, r.ids) THEN replace(rest, r.ids, '#') ELSE rest END,
    CASE WHEN contains(rest, r.ids) THEN list_append(found, r.licence) ELSE found END
  FROM steps s JOIN rules r ON r.k = s.k),
hits AS (SELECT rid, array_to_string(list_sort(list_distinct(flatten(list(found)))), ',') AS licences FROM steps WHERE k = {len(RULES)} GROUP BY rid)
SELECT doc_id, x.ids AS sentence_ids, y.ids AS wrapped_ids, coalesce(licences, '') AS licences,
  CAST(length(x.ids) - length(replace(x.ids, '<', '')) AS BIGINT) AS n_known
FROM d JOIN seqs x ON x.rid = d.rid AND x.v = 1 JOIN seqs y ON y.rid = d.rid AND y.v = 2 LEFT JOIN hits ON hits.rid = d.rid
"""


SQL = _sql()
