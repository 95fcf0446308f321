"""License scans by diagonal voting, natively.

All rolling k-gram hashes of a text's words are joined with the positions they have in license templates.  A copy of a
template shows as many hits with one offset (text position - template position): hits are counted by this diagonal,
neighbouring diagonals (words put in or left out) are merged to spans, and a span is verified by the share of the
template's k-grams it has and by its length.  A span with enough hits that is too long holds several copies or parts of
them and is split.  Every hit is confirmed on its words.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import broadcast_if_small, docs_of, table, written
from siltstone.llm.wordarrays import rolling, with_words

#: The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Public license notices, as their licences ask to state them.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Words of a gram; diagonals at most this far apart are one span; least share of a template's grams, in percent; a span's
#: words at most, in percent of the template's.
GRAM = 3
DRIFT = 8
COVERED = 60
STRETCH = 150


def template_grams(spark, templates=None) -> DataFrame:
    """(gram, words, template, label, at, grams): one row for each position in a template."""
    rows = [(i, label, text) for i, (label, text) in enumerate(TEMPLATES if templates is None else templates)]
    df = with_words(spark.createDataFrame(rows, "template int, label string, text string"), ascii_only=True)
    return (
        df.select("template", "label", "w", F.posexplode(rolling("w", GRAM)).alias("at", "gram"))
        .select("gram", F.expr(f"slice(w, at + 1, {GRAM})").alias("words"), "template", "label", "at", (F.size("w") - (GRAM - 1)).alias("grams"))
    )


def _fits(first: str, end: str) -> str:
    """The condition that words first..end are no more than a span may have."""
    return f"100 * ({end} - {first}) <= {STRETCH} * (grams + {GRAM - 1})"


#: Distinct grams of templates up to which they are told to the texts; the list in the code has some 700.
TOLD = 50_000


def _hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, x, pos, template, label, grams, at): places of texts whose words are those of a template's place.

    A text's words stay in its row: only places that may hit leave it, with their own words.  Templates beyond ``TOLD``
    grams are joined with all places instead.
    """
    place = lambda gram, i: F.struct(i.alias("pos"), gram.alias("gram"), F.slice("w", i + 1, GRAM).alias("own"))
    told = [r["gram"] for r in known.select("gram").distinct().limit(TOLD + 1).collect()]
    grams = F.transform(rolling("w", GRAM), lambda g, i: F.struct(g.alias("gram"), i.alias("i")))
    if len(told) <= TOLD:
        grams = F.filter(grams, lambda g: g["gram"].isin(told))
    places = docs.select("doc_id", "x", F.inline(F.transform(grams, lambda g: place(g["gram"], g["i"]))))
    return places.join(broadcast_if_small(written(known, "template-grams"), 200), "gram").filter(F.col("own") == F.col("words"))


def _split(loose: DataFrame) -> DataFrame:
    """Spans within merged diagonals that are too long for one; loose: a row for each diagonal, ``at`` has its positions.

    A diagonal with enough of the grams is a span of its own.  The other hits, one for each position, are cut where the
    place in the template falls back and at spans already found; a piece's best stretch of a span's length is verified.
    """
    key = ["doc_id", "x", "label", "template", "grams", "span"]
    loose = loose.withColumn("alone", F.expr(f"100 * size(at) >= {COVERED} * grams"))
    alone = loose.filter("alone").select(*key, F.size("at").alias("votes"), F.col("lo").alias("first_word"), (F.col("hi") + GRAM).alias("end_word"))
    hits = loose.select(*key, "diagonal", "votes", "alone", "hi", F.explode("at").alias("pos"))
    before = Window.partitionBy(*key).orderBy("pos", F.desc("alone"), "diagonal").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("found", F.sum(F.col("alone").cast("int")).over(before)).withColumn("until", F.max(F.when(F.col("alone"), F.col("hi"))).over(before))
    hits = hits.filter("not alone and (until is null or pos > until)")
    best = Window.partitionBy(*key, "pos").orderBy(F.desc("votes"), "diagonal")
    hits = hits.withColumn("best", F.row_number().over(best)).filter("best = 1").withColumn("place", F.col("pos") - F.col("diagonal"))
    order = Window.partitionBy(*key).orderBy("pos")
    goes_on = (F.col("place") > F.lag("place").over(order)) & (F.col("found") == F.lag("found").over(order))
    hits = hits.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("piece", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Places rise within a piece, so it has at most as many hits as the template has grams.
    pieces = hits.groupBy(*key, "piece").agg(F.array_sort(F.collect_list("pos")).alias("at")).filter(f"100 * size(at) >= {COVERED} * grams")
    stretches = pieces.withColumn("stretch", F.expr(f"transform(at, p -> filter(at, q -> q >= p and {_fits('p', f'q + {GRAM}')}))"))
    longest = stretches.withColumn("stretch", F.expr("array_max(transform(stretch, x -> struct(size(x) as votes, -x[0] as near, element_at(x, -1) as last)))"))
    parts = longest.select(*key, F.col("stretch.votes"), (-F.col("stretch.near")).alias("first_word"), (F.col("stretch.last") + GRAM).alias("end_word"))
    return alone.unionByName(parts.filter(f"100 * votes >= {COVERED} * grams"))


def license_spans(documents: DataFrame, templates=None) -> DataFrame:
    """(doc_id, label, template, first_word, end_word, covered): verified spans of templates, covered from 0 to 1.

    A span has ``COVERED`` percent of the template's positions, each counted once however often the text repeats it.  Rows
    that repeat doc_id and words give their spans once; rows with the same doc_id and other words are scanned on their own.
    """
    docs = with_words(docs_of(documents).filter("doc_id is not null"), ascii_only=True).select("doc_id", F.xxhash64("w").alias("x"), "w")
    known = template_grams(documents.sparkSession, templates)
    hits = _hits(docs, known)
    voted = (
        hits.select("doc_id", "x", "template", "label", "grams", "pos", (F.col("pos") - F.col("at")).alias("diagonal"))
        .groupBy("doc_id", "x", "template", "label", "grams", "diagonal")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("pos").alias("at"))
        .withColumn("votes", F.size("at"))
    )
    near = Window.partitionBy("doc_id", "x", "template").orderBy("diagonal")
    spanned = voted.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= DRIFT, 0).otherwise(1))
    spanned = spanned.withColumn("span", F.sum("new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    spanned = written(spanned.drop("new"), "diagonals")  # hits are few; the texts are read once for them
    # Each hit moves once to its span, where the template's positions are counted.
    of = ["doc_id", "x", "template", "span"]
    places = spanned.select(*of, F.explode("at").alias("pos"), "diagonal").groupBy(*of).agg(F.count_distinct(F.col("pos") - F.col("diagonal")).alias("all"))
    ends = spanned.groupBy(*of).agg(F.min("lo").alias("first_word"), (F.max("hi") + GRAM).alias("end_word"))
    merged = spanned.join(places, of).join(ends, of).filter(f"100 * all >= {COVERED} * grams")
    merged = written(merged, "spans")
    key = ["doc_id", "x", "label", "template", "grams", "span"]
    whole = merged.filter(_fits("first_word", "end_word")).select(*key, F.col("all").alias("votes"), "first_word", "end_word").distinct()
    spans = whole.unionByName(_split(merged.filter(f"not ({_fits('first_word', 'end_word')})").drop("all", "first_word", "end_word")))
    return spans.select("doc_id", "label", "template", "first_word", "end_word", F.least(F.lit(1.0), F.col("votes") / F.col("grams")).alias("covered"))


def license_scan(documents: DataFrame, templates=None) -> DataFrame:
    """Return, for every row with a doc_id, n_words, the base phrases' places (n_base, first_word, last_word, base_labels),
    labels (base ones and those of verified spans), score (the best span's coverage, at least 0.5 with a base phrase,
    else 0) and n_spans.  Null, empty and word-less texts have no words and labels ''.  Rows that repeat a doc_id share the
    spans found in any of them.
    """
    docs = with_words(docs_of(documents).filter("doc_id is not null"), ascii_only=True).select("doc_id", "w")

    def places(phrase: str):
        """Starts of the phrase in w: only texts with all of its words are searched."""
        words = phrase.split(" ")
        same = lambda i: F.forall(F.array(*(F.lit(k) for k in range(len(words)))), lambda k: F.get(F.col("w"), i + k) == F.get(F.array(*map(F.lit, words)), k))
        starts = F.filter(F.transform("w", lambda x, i: F.when(x == words[0], i)), lambda i: F.coalesce(same(i), F.lit(False)))
        return F.when(F.array_contains("w", words[0]) & F.array_contains("w", words[-1]), starts).otherwise(F.array().cast("array<int>"))

    base = docs.select("doc_id", F.size("w").cast("long").alias("n_words"), *(places(p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base = base.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)))))).alias("b"),
    )
    spans = license_spans(documents, templates).groupBy("doc_id").agg(F.collect_set("label").alias("s"), F.max("covered").alias("c"), F.count("*").alias("n_spans"))
    return base.join(spans, "doc_id", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("b", F.coalesce("s", F.array().cast("array<string>")))), ",").alias("labels"),
        F.greatest(F.coalesce("c", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op5: whole ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE = rf"""
with t as (select * from (values {", ".join(f"({i}, {_quoted(a)}, {_quoted(b)})" for i, (a, b) in enumerate(TEMPLATES))}) v(template, label, text)),
tw as (select template, label, list_filter(string_split_regex(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from t),
tg as (select template, label, len(w) - {GRAM - 1} grams, unnest(range(0, len(w) - {GRAM - 1})) "at", w from tw),
tk as (select template, label, grams, "at", array_to_string(w["at" + 1:"at" + {GRAM}], ' ') g from tg),
d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents where doc_id is not null),
p as (select doc_id, w, unnest(range(0, len(w))) i from d),
b as (select doc_id, i, case when w[i + 1] = 'mit' and w[i + 2] = 'license' then 'mit' when w[i + 1] = 'apache' and w[i + 2] = 'license' then 'apache'
        when w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license' then 'gpl' end l from p),
ba as (select doc_id, count(*) n_base, min(i) first_word, max(i) last_word, list(distinct l) ls from b where l is not null group by 1),
h as (select p.doc_id, template, label, grams, i pos, i - "at" diagonal from p join tk on array_to_string(p.w[i + 1:i + {GRAM}], ' ') = g where i + {GRAM} <= len(p.w)),
v as (select doc_id, template, label, grams, diagonal, list(distinct pos) "at", count(distinct pos) votes, min(pos) lo, max(pos) hi from h group by all),
m as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {DRIFT} then 0 else 1 end new from v),
g as (select *, sum(new) over (partition by doc_id, template order by diagonal rows unbounded preceding) span from m),
gp as (select doc_id, template, label, grams, span, diagonal, votes, hi, 100 * votes >= {COVERED} * grams alone, unnest("at") pos from g),
sp as (select doc_id, template, span, count(distinct pos - diagonal) votes, min(pos) f, max(pos) + {GRAM} e from gp group by all having 100 * count(distinct pos - diagonal) >= {COVERED} * any_value(grams)),
lo as (select gp.* from gp join sp using (doc_id, template, span) where 100 * (e - f) > {STRETCH} * (grams + {GRAM - 1})),
lf as (select *, sum(alone::int) over w found, max(case when alone then hi end) over w until from lo window w as (partition by doc_id, template, span order by pos, alone desc, diagonal rows unbounded preceding)),
lb as (select *, pos - diagonal place from lf where not alone and (until is null or pos > until) qualify row_number() over (partition by doc_id, template, span, pos order by votes desc, diagonal) = 1),
ln as (select *, case when place > lag(place) over w and found = lag(found) over w then 0 else 1 end new from lb window w as (partition by doc_id, template, span order by pos)),
lp as (select *, sum(new) over (partition by doc_id, template, span order by pos rows unbounded preceding) piece from ln),
ls as (select x.doc_id, x.template, x.span, x.label, x.grams, x.piece, x.pos f, count(*) votes, max(y.pos) + {GRAM} e from lp x join lp y using (doc_id, template, span, piece)
      where y.pos >= x.pos and 100 * (y.pos + {GRAM} - x.pos) <= {STRETCH} * (x.grams + {GRAM - 1}) group by all),
s as (select distinct doc_id, label, template, grams, span, sp.votes from g join sp using (doc_id, template, span) where 100 * (e - f) <= {STRETCH} * (grams + {GRAM - 1})
  union all select distinct doc_id, label, template, grams, span + diagonal / 1e9, votes from lo where alone
  union all select doc_id, label, template, grams, span + piece / 1e9, votes from ls where 100 * votes >= {COVERED} * grams qualify row_number() over (partition by doc_id, template, span, piece order by votes desc, f) = 1),
k as (select doc_id, list(distinct label) ls, max(least(1.0, votes / grams)) c, count(*) n_spans from s group by 1)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(array_to_string(list_sort(ba.ls), ','), '') base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(ba.ls, []), coalesce(k.ls, [])))), ','), '') labels,
  greatest(coalesce(c, 0.0), case when n_base > 0 then 0.5 else 0.0 end)::double score, coalesce(n_spans, 0)::bigint n_spans
from d left join ba using (doc_id) left join k using (doc_id)
"""
