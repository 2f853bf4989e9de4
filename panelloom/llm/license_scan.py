r"""License scan with DataFrame functions only: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

Words are runs outside [\x00-\x2F\x3A-\x60\x7B-\x7F] of the lower-cased text; shingles are `shingle` words, as 64-bit hashes.
Templates are dealt into classes by their number of distinct shingles t (c = the power of two from t on). For a class,
windows of 2c shingles start at every c-th shingle (c = 1: windows of one shingle), so an occurrence of t <= c shingles in a
row lies in a window as a whole. A band is the minimum of the window's hashes, hashed once more with the band's seed; the number
of bands follows from the smallest resemblance that a match of the class can have, p t / (2c + (1 - p) t) with p = percent/100
and t = c/2 + 1, so that a match is missed by all bands with a probability of at most `miss`. Windows and templates that agree
in a band meet by an equi-join on (class, band, key) and are verified: the window must hold at least `percent` per cent of the
template's distinct shingles.

Templates are a table (license_id, text) of at most MAX_TEMPLATES rows of at most MAX_WORDS words and at least `shingle` words
each; those bounds are checked and are what the broadcast rests on. Nothing else is collected. Nulls and edges: null or short
texts have no shingles and no match; texts of any length are read whole; a null id is reported as it is; rows that repeat an id
are reported together; ties are reported once, by the first window; other columns are ignored, whatever their names; no
templates, or an empty table, give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.licenses import TEMPLATES

MAX_TEMPLATES = 2000
MAX_WORDS = 20_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _with_shingles(df: DataFrame, text: Column, n: int) -> DataFrame:
    """df with _h, the hashes of all n-word shingles in order; fewer words give none."""
    words = F.filter(F.split(F.lower(text), SEPARATORS), lambda x: x != "")
    parts = ", ".join(f"_w[i + {k}]" for k in range(n))
    return (
        df.withColumn("_w", words)
        .withColumn("_h", F.expr(f"CASE WHEN size(_w) >= {n} THEN transform(sequence(0, size(_w) - {n}), i -> xxhash64({parts})) ELSE CAST(array() AS array<bigint>) END"))
        .drop("_w")
    )


def bands_needed(resemblance: float, miss: float) -> int:
    """Bands of one row such that (1 - resemblance) ** bands <= miss."""
    return 1 if resemblance >= 1 else math.ceil(math.log(miss) / math.log(1 - resemblance))


def license_scan(docs: DataFrame, templates: DataFrame | list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """One row for each document and license found: doc_id, license_id, n_template, n_shared (largest), first_window (first shingle of it)."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    if isinstance(templates, list):
        templates = spark.createDataFrame(templates, "license_id string, text string")
    listed = _with_shingles(templates.select("license_id", "text"), F.col("text"), shingle).select("license_id", F.array_distinct("_h").alias("h"))
    # one row of counts: the bounds of the broadcast
    n, least, most = listed.agg(F.count("*"), F.min(F.size("h")), F.max(F.size("h"))).first()
    if n > MAX_TEMPLATES or (most or 0) > MAX_WORDS:
        raise ValueError(f"more than {MAX_TEMPLATES} templates, or one of over {MAX_WORDS} words")
    if n and not least:
        raise ValueError(f"templates of fewer than {shingle} words")
    share = percent / 100
    classes = [1 << k for k in range((most or 1).bit_length() + 1) if 1 << k < 2 * (most or 1)]
    bands = {c: 1 if c == 1 else bands_needed(share * (c // 2 + 1) / (2 * c + (1 - share) * (c // 2 + 1)), miss) for c in classes}
    count = f"CASE c {' '.join(f'WHEN {c} THEN {b}' for c, b in bands.items())} END"
    # the templates' own minima, each with its shingle, by the same functions; MAX_TEMPLATES rows of some dozens of bands
    sized = listed.withColumn("c", F.expr("CAST(shiftleft(1L, CAST(ceil(log2(size(h))) AS INT)) AS INT)"))
    banded = sized.select("license_id", "c", "h", F.posexplode(F.expr(f"transform(sequence(1, {count}), s -> array_min(transform(h, x -> struct(xxhash64(x, s) AS key, x AS shingle))))")).alias("band", "least"))
    banded = banded.select("license_id", "c", "h", "band", "least.key", "least.shingle")
    # a band agrees only where the window holds the template's least shingle itself (equal keys under one seed are equal
    # hashes), so texts and windows without any such shingle need no bands
    held = banded.agg(F.collect_set("shingle").alias("held")).scalar()
    # outer explode: its empty rows are dropped below, while the inner form would add a filter that hashes every text once more
    hashed = _with_shingles(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"), shingle).drop("text")
    grids = [f"transform(sequence(0, size(_h) - 1, {c}), s -> struct({c} AS c, s AS at, slice(_h, s + 1, {c if c == 1 else 2 * c}) AS win))" for c in classes]
    grid = F.when(F.arrays_overlap("_h", held), F.expr(f"concat({', '.join(grids)})"))
    windows = hashed.select("doc_id", F.explode_outer(grid).alias("g")).select("doc_id", "g.c", "g.at", "g.win")
    near = windows.filter(F.arrays_overlap("win", held))
    signed = near.select("doc_id", "c", "at", "win", F.posexplode_outer(F.expr(f"transform(sequence(1, {count}), s -> array_min(transform(win, x -> xxhash64(x, s))))")).alias("band", "key"))
    hits = signed.join(F.broadcast(banded.drop("shingle")), ["c", "band", "key"])
    matched = hits.withColumn("n_shared", F.size(F.array_intersect("win", "h"))).filter(F.col("n_shared") * 100 >= F.size("h") * percent)
    return matched.groupBy("doc_id", "license_id", F.size("h").alias("n_template")).agg(F.max("n_shared").alias("n_shared"), F.min("at").alias("first_window"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, shingle: int = 5, percent: int = 80) -> str:
    """DuckDB SQL for license_scan: every window of the same grid against every template's shingles, without bands."""
    listed = ", ".join(f"('{i}', '{t.replace(chr(39), chr(39) * 2)}')" for i, t in templates)
    cut = "list_filter(string_split_regex(lower({}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    gram = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))".format(n=shingle)
    return f"""
WITH t(license_id, txt) AS (VALUES {listed}),
tw AS (SELECT license_id, {cut.format("txt")} AS w FROM t),
ts AS (SELECT DISTINCT license_id, unnest({gram}) AS g FROM tw),
tn AS (SELECT license_id, count(*) AS n_template, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS c FROM ts GROUP BY 1),
dw AS (SELECT doc_id, {cut.format("text")} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, unnest({gram}) AS g, unnest(range(0, len(w) - {shingle - 1})) AS p FROM dw WHERE len(w) >= {shingle}),
hit AS (SELECT doc_id, license_id, n_template, c, p, g FROM ds JOIN ts USING (g) JOIN tn USING (license_id)),
win AS (SELECT doc_id, license_id, n_template, g, (p // c) * c AS s FROM hit
        UNION ALL SELECT doc_id, license_id, n_template, g, (p // c - 1) * c FROM hit WHERE c > 1 AND p >= c),
per AS (SELECT doc_id, license_id, n_template, s, count(DISTINCT g) AS n FROM win GROUP BY ALL)
SELECT doc_id, license_id, n_template, max(n) AS n_shared, min(s) AS first_window FROM per WHERE n * 100 >= n_template * {percent} GROUP BY ALL"""
