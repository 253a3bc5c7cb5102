"""License scan by diagonal voting: k-gram hits against license templates, voted by offset diagonal.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import plain_words, table
from .decontaminate import WORDS_SQL

#: Phrases whose words must stand one after another, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Whole texts and notices of public licenses, as plain words; the label each gives; and the words without
#: which a passage is another license (none: any passage that follows the text).
TEMPLATES = [
    ("released under the mit license", "mit", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit-text", "",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text", ""),
    ("licensed under the apache license version 2 0", "apache-2.0", "apache 2"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed "
        "on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions "
        "and limitations under the license",
        "apache-2.0", "apache",
    ),
    ("licensed under the gnu general public license version 3", "gpl-3.0", "3"),
    ("licensed under the gnu general public license version 2", "gpl-2.0", "2"),
    ("redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-text", "gnu general"),
    ("redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl-text", "lesser"),
    ("redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl-text", "affero"),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "bsd-text", "",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text", ""),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of "
        "or in connection with the use or performance of this software",
        "isc-text", "",
    ),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text", ""),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla 2"),
    ("licensed under cc by 4 0", "cc-by-4.0", "by 4"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "nc 4"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "sa 4"),
    ("this is free and unencumbered software released into the public domain", "unlicense-text", ""),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense-text", "",
    ),
]
#: Words in a k-gram, and the share of a passage and its template that must agree.
K, SHARE = 3, 0.6


def near(n_words: int) -> int:
    """How far apart neighbouring diagonals of one passage may be: inserted or missing words in a row."""
    return max(1, min(16, n_words // 4))


def template_grams(templates: list[tuple[str, str, str]]) -> list[tuple[int, str, int, int, list[int], int, str, str, str]]:
    """(template, label, its words, near, places of the words that must stand, place, and the three words there)."""
    out = []
    for t, (text, label, must) in enumerate(templates):
        w = text.split()
        needed = [w.index(m) for m in must.split()]
        out += [(t, label, len(w), near(len(w)), needed, i, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return out


def _stands(words: Column, phrase: str) -> Column:
    """The places where a phrase's words stand."""
    parts = phrase.split()
    starts = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(lambda a, b: a & b, (F.get(words, i + k) == p for k, p in enumerate(parts))))


def license_spans(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, label, first_word, last_word, share): passages that follow a template, possibly with words changed.

    Every k-gram of every document is joined by a rolling hash to the template positions (a constant, so it is broadcast),
    and the words are compared.  Hits vote for the diagonal document position - template position; a template's diagonals
    that are at most ``near`` apart are one passage.  Its share is the number of template words that its hits cover, by the
    length of the template or of the passage, whichever is more; at SHARE it counts, if the words that must stand are
    covered.  Of passages that overlap, one after another, only the best stays: the largest share, then the most covered
    words, then the first label.  So a notice of one license is not taken for a similar one.

    ``templates`` are (text of plain words, label, words that must stand); whole license texts may be added.
    """
    spark = docs.sparkSession
    grams = F.broadcast(spark.createDataFrame(template_grams(templates), "t int, label string, n int, near int, must array<int>, tpos int, a string, b string, c string").withColumn("h", F.xxhash64("a", "b", "c")))
    words = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    # neighbouring words side by side; only they go on with a position, not the document
    rolled = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("c"))
    placed = words.select("doc_id", F.posexplode(rolled).alias("pos", "g")).where("g.c is not null").select("doc_id", "pos", "g.a", "g.b", "g.c", F.xxhash64("g.a", "g.b", "g.c").alias("h"))
    hits = placed.join(grams, ["h", "a", "b", "c"])
    votes = hits.groupBy("doc_id", "t", "label", "n", "near", "must", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("at"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    along = W.Window.partitionBy("doc_id", "t").orderBy("diagonal")
    votes = votes.withColumn("gap", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > F.col("near")).cast("int"), F.lit(1)))
    votes = votes.withColumn("passage", F.sum("gap").over(along))
    passages = votes.groupBy("doc_id", "t", "label", "n", "must", "passage").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("low").alias("low"), (F.max("high") + K - 1).alias("high"))
    covered = F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(*[i + k for k in range(K)]))))
    passages = passages.withColumn("covered", covered).withColumn("share", F.size("covered") / F.greatest(F.col("n"), F.col("high") - F.col("low") + 1))
    passages = passages.where((F.col("share") >= SHARE) & (F.size(F.array_except("must", "covered")) == 0))
    # passages that overlap follow one another in order of their first words
    ordered = W.Window.partitionBy("doc_id").orderBy("low", "high", "t")
    passages = passages.withColumn("reach", F.max("high").over(ordered.rowsBetween(W.Window.unboundedPreceding, -1)))
    passages = passages.withColumn("place", F.sum(F.coalesce((F.col("low") > F.col("reach")).cast("int"), F.lit(1))).over(ordered))
    best = W.Window.partitionBy("doc_id", "place").orderBy(F.desc("share"), F.desc(F.size("covered")), "label", "t")
    passages = passages.withColumn("rank", F.row_number().over(best)).where("rank = 1")
    return passages.select("doc_id", "label", F.col("low").cast("long").alias("first_word"), F.col("high").cast("long").alias("last_word"), "share")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per input row: word count, base phrases (number, first and last place, labels), all labels, score.

    ``score`` is the largest share of a passage that follows a template, 1 if a base phrase stands.  Null texts have no
    words.  Rows that share a doc_id share their passages; rows with a null doc_id get base labels only.
    """
    per_doc = license_spans(docs.where("doc_id is not null")).groupBy("doc_id").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))
    rows = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    phrases = list(PHRASES.items())
    places = F.array(*[_stands(F.col("w"), p) for p, _ in phrases])
    none = F.array(*[F.array().cast("array<int>")] * len(phrases))
    # the places are looked for only where a phrase's last word stands at all
    rows = rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.when(F.array_contains("w", "license"), places).otherwise(none).alias("places"))
    rows = rows.withColumn("all", F.flatten("places")).withColumn("base", F.filter(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull()))
    return rows.join(per_doc, "doc_id", "left").select(
        "doc_id",
        "n_words",
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("all") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and the licenses whose texts or notices it follows."""
    return scan_licenses(table(spark, sf_dir, "documents"))


_GRAM_ROWS = ", ".join(f"({t}, '{label}', {n}, {near_}, {must}::integer[], {i}, '{a} {b} {c}')" for t, label, n, near_, must, i, a, b, c in template_grams(TEMPLATES))
_PHRASE_ROWS = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())

OP7_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents),
t(t, label, n, near, must, tpos, gram) as (values {_GRAM_ROWS}),
p(phrase, label, k) as (values {_PHRASE_ROWS}),
starts as (select doc_id, unnest(range(len(w))) as pos, w from d where list_contains(w, 'license')),
base as (select doc_id, pos, label from starts join p on array_to_string(w[pos + 1:pos + k], ' ') = phrase),
b as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels from base group by doc_id),
g as (select doc_id, unnest(range(len(w) - {K - 1})) as pos, w from d),
hits as (select doc_id, t, label, n, near, must, pos, tpos, pos - tpos as diagonal from (select doc_id, pos, array_to_string(w[pos + 1:pos + {K}], ' ') as gram from g) join t using (gram)),
v as (select distinct doc_id, t, near, diagonal from hits),
steps as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, t order by diagonal) <= near then 0 else 1 end as gap from v),
islands as (select *, sum(gap) over (partition by doc_id, t order by diagonal) as passage from steps),
spans as (
  select doc_id, t, label, n, must, min(pos) as low, max(pos) + {K - 1} as high,
         list_distinct(flatten(list([tpos, tpos + 1, tpos + 2]))) as covered
  from hits join islands using (doc_id, t, diagonal) group by doc_id, t, label, n, must, passage
),
shares as (select *, len(covered) / greatest(n, high - low + 1) as share from spans where list_has_all(covered, must)),
reached as (select *, max(high) over (partition by doc_id order by low, high, t rows between unbounded preceding and 1 preceding) as reach from shares where share >= {SHARE}),
places as (select *, sum(case when low <= reach then 0 else 1 end) over (partition by doc_id order by low, high, t) as place from reached),
found as (select * from places qualify row_number() over (partition by doc_id, place order by share desc, len(covered) desc, label, t) = 1),
f as (select doc_id, list(distinct label) as labels, max(share) as share from found group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0 else coalesce(share, 0.0) end::double as score
from d left join b using (doc_id) left join f using (doc_id)
"""
