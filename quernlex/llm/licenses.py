"""License scans: an exact set-similarity join of text blocks with license templates.

Templates are token sets. Tokens are ordered by how often they occur in all documents, rarest
first. A block can hold `threshold` of a template's tokens only if it has one of its first
|T| - need + 1 tokens (prefix filter), if it is long enough (length filter), and if enough
tokens of the template come after the first of them that it has (positional filter). Blocks are
three times as long as the template and start at multiples of its length, so any stretch of
twice that length lies in one; they are read where prefix tokens stand. What passes is counted
exactly, and every pair of block and template that meets the threshold is returned. Most words of
a license are every other license's too, so only those pairs give a label whose block also has the
words in which the template names its license, one of a few phrases for each of them. A few exact
phrases are found besides, by place.

All of it is column expressions over one row at a time: no shuffle but for the token counts.
"""

from __future__ import annotations

import re
from functools import reduce
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Exact phrases, as words.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    """A license's label, words by which it is applied to a work, and the phrases of which a block needs one to be labelled; with no phrases it needs none."""

    label: str
    text: str
    names: tuple[str, ...]


# Words of common licenses, of the notices that apply them, and their names.
_APACHE_2 = ("apache license version 2", "apache license v2", "apache license 2", "apache 2")
_GPL_2 = ("gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2")
_GPL_3 = ("gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3")
_GNU_HEADER = (
    "this program is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
    " either version {version} of the license or at your option any later version this program is distributed in the hope that it will be useful"
    " but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details"
)
TEMPLATES = [
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "this project is licensed under the terms of the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
        " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
        " copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability"
        " whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge to any person",),
    ),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge to any person",)),
    Template("apache-2", "licensed under the apache license version 2 0", _APACHE_2),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"
        " software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        _APACHE_2,
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial", "attribution non commercial")),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike", "attribution share alike")),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4", "cc by 3", "cc by 2")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("commons attribution 4", "commons attribution 3", "commons attribution 2")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", _GPL_3),
    Template("gpl-2", "under the terms of the gnu general public license version 2", _GPL_2),
    Template("gpl-3", "gnu gpl version 3", _GPL_3),
    Template("gpl-2", "gnu gpl version 2", _GPL_2),
    Template("gpl-3", "gpl version 3", _GPL_3),
    Template("gpl-2", "gpl version 2", _GPL_2),
    Template("gpl-3", "gplv3", ("gplv3",)),
    Template("gpl-2", "gplv2", ("gplv2",)),
    Template("gpl-3", _GNU_HEADER.format(name="gnu general public license", version="3"), ("version 3 of the license",)),
    Template("gpl-2", _GNU_HEADER.format(name="gnu general public license", version="2"), ("version 2 of the license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2", "mozilla public license version 2", "mozilla public license 2")),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
        ("redistribution and use in source and binary forms",),
    ),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
]


def _plain(text: str) -> list[str]:
    """The words of a template or name, as those of a document are taken."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


def _normal(text: Column) -> Column:
    """' word word ... ' of lower-cased words; one blank where there are none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() makes ASCII letters of two other characters only: the Kelvin sign and the dotted I
    odd = spaced.contains("K") | spaced.contains("İ")
    folded = F.when(odd, F.translate(spaced, upper, lower)).otherwise(F.lower(spaced))
    return F.concat(F.lit(" "), F.trim(folded), F.lit(" "))


def token_order(docs: DataFrame, text_col: str, tokens: list[str]) -> dict[str, int]:
    """The tokens' places, rarest first, by their occurrences in all documents (ties by name)."""
    words = F.filter(F.split(_normal(F.col(text_col)), " "), lambda w: w.isin(tokens))
    counted = {r["w"]: r["n"] for r in docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (counted.get(t, 0), t)))}


def _places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase starts."""
    parts = phrase.split()

    def starts(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + j).eqNullSafe(F.lit(p)) for j, p in enumerate(parts)])

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts)


def _has(norm: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [norm.contains(f" {p} ") for p in phrases], F.lit(False))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[Template] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks, pairs.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and characters from U+0080; a null
    or empty text has none; so are those of templates. n_base counts the places of all phrases;
    pairs holds every block that has `threshold` (above 0) or more of a template's tokens, as label,
    start (words from 0), share and named: whether it has one of the template's names, or the
    template has none. blocks are the named ones, without that column; labels are those of the
    phrases and blocks. score is 1 where a phrase stands, else the largest share of a block, 0 if
    none. Ids may be null, repeated or of any type; texts may be of any length. Empty tables give no
    rows; other columns are not read, so their names may be any.
    """
    cut = [(t._replace(names=tuple(" ".join(_plain(n)) for n in t.names)), _plain(t.text)) for t in templates]
    sets = [(t, sorted(set(w)), len(w)) for t, w in cut if w]
    order = token_order(docs, text_col, sorted({x for _, s, _ in sets for x in s})) if sets else {}
    rows = docs.select(F.col(id_col).alias("doc_id"), _normal(F.col(text_col)).alias("norm"))
    blanks = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))
    rows = rows.withColumn("n_words", F.when(F.trim("norm") == "", 0).otherwise(blanks - 1).cast("long"))

    none = F.array().cast("array<string>")
    rows = rows.withColumn("words", F.when(F.col("n_words") > 0, F.split(F.trim("norm"), " ")).otherwise(none))
    # a block has no more of a template's tokens than its text has
    rows = rows.withColumn("known", F.array_intersect(F.array(*map(F.lit, order)), "words") if order else none)

    words = F.col("words")
    places = {p: F.when(F.col("norm").contains(f" {p} "), _places(words, p)).otherwise(F.array().cast("array<int>")) for p in phrases}
    rows = rows.withColumn("at", F.flatten(F.array(*places.values())) if phrases else F.array().cast("array<int>"))
    base = [F.when(F.col("norm").contains(f" {p} "), F.lit(label)) for p, label in phrases.items()]
    rows = rows.withColumn("base", F.when(F.size(words) > 0, F.array_compact(F.array(*base))).otherwise(none) if phrases else none)
    kind = "array<struct<label: string, start: int, share: double, named: boolean>>"

    def passing(template: Template, tokens: list[str], length: int) -> Column:
        tokens = sorted(tokens, key=order.__getitem__)
        need = ceil(threshold * len(tokens) - 1e-9)
        prefix = tokens[: len(tokens) - need + 1]
        listed = F.array(*map(F.lit, tokens))
        near = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(prefix))
        here = F.transform(near, lambda i: F.floor(i / length).cast("int"))
        numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(here, lambda k: F.array(k - 2, k - 1, k)))))

        def share(b: Column) -> Column:
            block = F.slice(words, b * length + 1, 3 * length)
            first = F.array_min(F.transform(F.array_intersect(F.array(*map(F.lit, prefix)), block), lambda t: F.array_position(listed, t)))
            enough = (F.size(block) >= need) & (len(tokens) + 1 - first >= need)
            held = F.when(enough, F.size(F.array_intersect(listed, block)))
            return F.when(held >= need, held / F.lit(float(len(tokens))))

        def named(start: Column) -> Column:
            block = F.slice(words, start + 1, 3 * length)
            return _has(F.concat(F.lit(" "), F.array_join(block, " "), F.lit(" ")), template.names) if template.names else F.lit(True)

        found = F.transform(F.filter(numbers, lambda b: b >= 0), lambda b: F.struct((b * length).cast("int").alias("start"), share(b).alias("share")))
        found = F.transform(
            F.filter(found, lambda x: x["share"].isNotNull()), lambda x: F.struct(F.lit(template.label).alias("label"), x["start"].alias("start"), x["share"].alias("share"), named(x["start"]).alias("named"))
        )
        may = (F.size("known") >= need) & (F.size(F.array_intersect(listed, "known")) >= need)
        return F.when(may, found).otherwise(F.array().cast(kind))

    rows = rows.withColumn("pairs", F.flatten(F.array(*[passing(*x) for x in sets])) if sets else F.array().cast(kind))
    blocks = F.transform(F.filter("pairs", lambda x: x["named"]), lambda x: F.struct(*[x[c].alias(c) for c in ("label", "start", "share")]))
    rows = rows.withColumn("blocks", blocks)
    n_base = F.size("at").cast("long")
    shares = F.transform("blocks", lambda x: x["share"])
    labels = F.concat("base", F.transform("blocks", lambda x: x["label"]))
    return rows.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"),
        "blocks",
        "pairs",
    )
