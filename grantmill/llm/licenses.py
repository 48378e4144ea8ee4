"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks, so that every run of `STRIDE` words lies
in one of them. A template is the set of its words; it is found in a block if the share
of its words that the block has (its containment) reaches the threshold. Words are
ordered by their number of texts, rarest first. A block and a template can only reach
the threshold if they share a word of the template's prefix in that order; pairs are made
from such words only, and dropped if the block's number of template words or the places
of the first shared word in both orders leave too little. What is left is counted exactly.
Phrases are then looked for, word by word, in the blocks their templates were found in.

Templates are a parameter of the caller, at most `MOST_TEMPLATE_WORDS` words together;
their index is what is broadcast. Null and empty texts have no words. Every row gives one
row, repeated rows and null ids included. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE = 32
MOST_TEMPLATE_WORDS = 20_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A license text. A phrase is also looked for as consecutive words."""

    label: str
    text: str
    phrase: bool = False


# Wordings of common license lines (fixed values).
PHRASES = (
    Template("mit", "under the mit license", phrase=True),
    Template("apache-2", "apache license version 2", phrase=True),
    Template("cc-by-nc", "cc by nc", phrase=True),
)
LINES = (
    Template("mit", "released under the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3"),
)


def words(text: str) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII; ASCII letters lowered.

    The Kelvin sign is the one other character whose lower case is an ASCII letter; any
    letter beyond ASCII may stand for it, as words with one equal no template word.
    """
    lowered = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\u212a"), F.lit("\u043a")))
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def scan(
    df: DataFrame,
    templates: tuple[Template, ...] = PHRASES + LINES,
    threshold: float = 0.85,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each row: (id_col, n_words, hits), hits an array of structs
    (template, label, start, containment, places), one for each block and template found.

    start is the block's first word; places are the starts of a phrase in the text, each
    in one block only, empty for templates that are no phrases. Words count from 0.
    """
    spark = df.sparkSession
    wanted = [t.text.split() for t in templates]
    if any(not w or len(w) > STRIDE for w in wanted):
        raise ValueError(f"a template has 1 to {STRIDE} words")
    if sum(map(len, wanted)) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
    vocabulary = sorted({w for t in wanted for w in t})
    split = df.select(F.col(id_col).alias("id"), words(text_col).alias("words"))
    known = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    # At most as many rows as the templates have words.
    found_in = dict(
        split.select(F.explode(F.array_intersect(known, "words")).alias("word")).groupBy("word").count().collect()
    )
    order = sorted(vocabulary, key=lambda w: (found_in.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for number, (template, own) in enumerate(zip(templates, wanted, strict=True)):
        tokens = sorted(set(own), key=rank.__getitem__)
        needed = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        prefix = tokens[: len(tokens) - needed + 1]
        for place, word in enumerate(prefix):
            index.append((word, number, template.label, tokens, prefix, place, needed, own if template.phrase else []))
    schema = (
        "word string, template int, label string, tokens array<string>, prefix array<string>, place int, needed int, phrase array<string>"
    )
    prefixes = F.array(*[F.lit(w) for w in order if any(w == row[0] for row in index)]) if index else F.array().cast("array<string>")
    ordered = F.array(*map(F.lit, order)) if order else F.array().cast("array<string>")

    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STRIDE))
    blocks = F.filter(
        F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(F.col("words"), s + 1, 2 * STRIDE).alias("words"))),
        lambda b: F.arrays_overlap(b["words"], prefixes),
    )
    # A row's number is made in the task that reads it, so the shuffle below only gathers a row's own blocks.
    rows = split.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        n.alias("n_words"),
        F.when(F.arrays_overlap("words", prefixes), blocks).alias("blocks"),
    )
    in_blocks = rows.select("row", "id", "n_words", F.explode_outer("blocks").alias("block")).withColumn(
        "shared", F.array_intersect(ordered, "block.words")
    )
    by_word = in_blocks.withColumn("word", F.explode_outer(F.array_intersect(prefixes, F.col("shared"))))
    pairs = by_word.join(F.broadcast(spark.createDataFrame(index, schema)), "word", "left")
    # Of several shared prefix words the first makes the pair.
    first = F.col("word") == F.array_intersect("prefix", "shared")[0]
    enough = F.size("shared") >= F.col("needed")
    after = F.least(F.size("tokens") - F.col("place"), F.size("shared") - F.array_position("shared", F.col("word")) + 1)
    overlap = F.size(F.array_intersect("tokens", "shared"))
    size = F.size("phrase")
    inside = F.sequence(F.lit(0), F.least(F.size("block.words") - size, F.lit(STRIDE - 1)))
    places = F.when(
        (size > 0) & (F.size("block.words") >= size),
        F.transform(
            F.filter(inside, lambda i: F.slice(F.col("block.words"), i + 1, F.size("phrase")) == F.col("phrase")),
            lambda i: (F.col("block.start") + i).cast("long"),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hit = F.when(
        first & enough & (after >= F.col("needed")) & (overlap >= F.col("needed")),
        F.struct(
            "template",
            "label",
            F.col("block.start").cast("long").alias("start"),
            (overlap / F.size("tokens")).alias("containment"),
            places.alias("places"),
        ),
    )
    return (
        pairs.select("row", "id", "n_words", hit.alias("hit"))
        .groupBy("row")
        .agg(F.first("id").alias(id_col), F.first("n_words").cast("long").alias("n_words"), F.collect_list("hit").alias("hits"))
        .drop("row")
    )
