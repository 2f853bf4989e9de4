"""A large group of copies that share most shingles but don't link: its pairs go as they meet, and no link is lost."""

import random

from pyspark.sql import functions as F

from panelloom.llm import jaccard_join


def test_pairs_of_a_group_that_does_not_link(spark):
    draw = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in draw.sample(range(5, 145), 4):
            words[at] = f"x{draw.randrange(8)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i][1] + " tail") for i in range(3)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.a, r.b) for r in jaccard_join.jaccard_links(df).collect()} == want
    join = jaccard_join._Join(jaccard_join._prepared(df, "doc_id", "text"), 5, 80)
    pairs = {(r.a, r.b) for r in join.all_pairs(join.buckets().withColumn("comp", F.col("id"))).collect()}
    assert want <= pairs and len(pairs) <= 2 * len(want) + 20
