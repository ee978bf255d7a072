"""License scans (operator 5), in DataFrame operations only: a positional rare-token index.

The index holds licence templates as word lists. A word's IDF over the templates tells how rare
it is; a template is posted under its rarest words with their positions. In a text, the places of
these words give, less the word's position in the template, the places where the template could
start; the postings of a template's rare words are intersected by that relative position, and at
what is left the mandatory key phrases are verified word by word. Whatever the text holds, a
template that stands there has all its rare words in place, so none is missed.

The index is a constant of the plan: it has no more entries than the templates have words. Every
text is read once, without a shuffle or a join.

Defined results: A-Z are lower-cased and words are runs of letters, digits and characters beyond
ASCII; texts of any length are scanned whole; a null text counts as empty and has no words; repeated rows are scanned each on their own;
ties between starts count each; other input columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases whose every place counts, and their labels.
BASE_PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Notices by label, and the phrases in them that must stand as they are.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "to any person obtaining a copy")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee is hereby granted")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited", ("unauthorized copying of this file",)),
)

#: Words of a template whose postings are intersected.
RARE_WORDS = 2


@dataclass(frozen=True)
class Template:
    """A posted word list; ``keys`` are (position, words) that must match."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool


def _place(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def templates() -> list[Template]:
    out = [Template(label, tuple(p.split()), ((0, tuple(p.split())),), True) for p, label in BASE_PHRASES]
    for label, notice, phrases in NOTICES:
        words = notice.split()
        keys = tuple((_place(words, p.split()), tuple(p.split())) for p in phrases)
        out.append(Template(label, tuple(words), keys, False))
    return out


def idf(all_templates: list[Template]) -> dict[str, float]:
    """Inverse template frequency by word."""
    n = len(all_templates)
    vocabulary = {w for t in all_templates for w in t.words}
    return {w: round(math.log((1 + n) / sum(w in t.words for t in all_templates)), 6) for w in vocabulary}


def rare_positions(t: Template, weight: dict[str, float]) -> list[int]:
    """Positions of the key words with the highest IDF, each word once."""
    places = [i + j for i, words in t.keys for j in range(len(words))]
    first = {t.words[p]: p for p in reversed(places)}
    return sorted(sorted(first.values(), key=lambda p: (-weight[t.words[p]], p))[:RARE_WORDS])


def normalised(text: Column) -> Column:
    """Lower-cased words joined by single spaces, without outer spaces."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(lowered, SEPARATORS, " "))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's licences: id_col, n_words (long), hits (array of label, start, base, score:
    the share by IDF of the template's words that stand in place)."""
    index = templates()
    weight = idf(index)
    rare = {t: rare_positions(t, weight) for t in index}
    posted = sorted({t.words[p] for t in index for p in rare[t]})

    def has(word: str) -> Column:
        return F.contains(F.col("padded"), F.lit(f" {word} "))

    scanned = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    scanned = scanned.select("id", "norm", F.concat(F.lit(" "), F.col("norm"), F.lit(" ")).alias("padded"))
    # only texts that hold all rare words of some template are split into words
    candidate = {t: _all([has(t.words[p]) for p in rare[t]]) for t in index}
    some = candidate[index[0]]
    for t in index[1:]:
        some = some | candidate[t]
    scanned = scanned.withColumn("words", F.when(some, F.split("norm", " ")))
    is_posted = lambda w: w.isin(posted)
    places = F.filter(F.transform("words", lambda w, i: F.when(is_posted(w), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())
    scanned = scanned.withColumn("places", places)
    n_words = F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1)
    none = F.expr("cast(array() as array<struct<label:string,start:int,base:boolean,score:double>>)")
    found = F.expr("flatten(array(" + ",\n".join(_template_hits(t, rare[t], weight) for t in index) + "))")
    hits = F.when(F.col("words").isNull() | (F.size("places") == 0), none).otherwise(found)
    return scanned.select(F.col("id").alias(id_col), n_words.cast("long").alias("n_words"), hits.alias("hits"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _template_hits(t: Template, rare: list[int], weight: dict[str, float]) -> str:
    """SQL of the hits of one template, from the places of its rare words."""
    quoted = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
    starts = ""
    for p in rare:
        of_word = f"transform(filter(places, h -> h.w = '{t.words[p]}'), h -> h.i - {p})"
        starts = f"array_intersect({starts}, {of_word})" if starts else of_word
    keys = " AND ".join(f"s >= {-i} AND slice(words, greatest(s + {i}, 0) + 1, {len(phrase)}) = {quoted(phrase)}" for i, phrase in t.keys)
    weights = "array(" + ", ".join(f"{weight[w]!r}D" for w in t.words) + ")"
    total = sum(weight[w] for w in t.words)
    share = f"aggregate(sequence(0, {len(t.words) - 1}), 0D, (a, j) -> a + if(get(words, s + j) = get({quoted(t.words)}, j), get({weights}, j), 0D))"
    hit = f"named_struct('label', '{t.label}', 'start', s, 'base', {str(t.base).lower()}, 'score', least(1D, round({share} / {total!r}D, 6)))"
    return f"transform(filter({starts}, s -> {keys}), s -> {hit})"


def scan_sql() -> str:
    """The op5 result in DuckDB SQL: every template tried at every word."""
    index = templates()
    weight = idf(index)
    tries = []
    for t in index:
        key = " AND ".join(f"w[s+{i + j + 1}] = '{word}'" for i, phrase in t.keys for j, word in enumerate(phrase))
        share = " + ".join(f"CASE WHEN s+{i + 1} >= 1 AND w[greatest(s+{i + 1}, 1)] = '{word}' THEN {weight[word]} ELSE 0 END" for i, word in enumerate(t.words))
        total = sum(weight[w] for w in t.words)
        least = -min(i for i, _ in t.keys)
        tries.append(
            f"SELECT doc_id, '{t.label}' AS label, s AS start, {t.base} AS base, least(1.0, round(({share})::DOUBLE / {total!r}::DOUBLE, 6)) AS score "
            f"FROM words, range({least}, len(w)) AS r(s) WHERE contains(norm, '{' '.join(t.keys[0][1])}') AND {key}"
        )
    union = "\nUNION ALL ".join(tries)
    return f"""
    WITH norms AS (
      SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATORS}', ' ', 'g')) AS norm FROM documents),
    words AS (SELECT doc_id, norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM norms),
    hits AS ({union})
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
           count(*) FILTER (base)::BIGINT AS n_base, min(start) FILTER (base)::BIGINT AS first_word, max(start) FILTER (base)::BIGINT AS last_word,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
           coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
           coalesce(max(score), 0.0)::DOUBLE AS score
    FROM words d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id, d.w
    """
