"""Pairs of similar names where many companies bear one name, held against all pairs."""

import itertools
import random

from prospecta.functions.text import normalize_name
from prospecta.operators import relations

COMPANY = "id long, workspace_id string, city string, denomination string"


def grams(name):
    text = f"  {name} "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def test_pairs_are_those_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(relations, "CHUNK", 3)
    rng = random.Random(4)
    names = ["Café  Noël 12", "cafe noel 12", "Café Noël 13", "Acme Tech", "Compagnie Générale Travaux Publics Ouest 1", "Compagnie Générale Travaux Publics Ouest 12", "Les Étoiles du Nord 𝒳𝒴𝒵", "Étoiles Nord 𝒳𝒴𝒵", "", None, "x"]
    rows = [(i, rng.choice(["w0", "w0", "w1", None]), rng.choice(["a", "a", "b", None]), rng.choice(names)) for i in rng.sample(range(1000), 260)]
    df = spark.createDataFrame(rows, COMPANY).repartition(3)
    normal = {r.id: r.n for r in df.select("id", normalize_name(df.denomination).alias("n")).collect()}
    want = {}
    for a, b in itertools.combinations(sorted(r for r in rows if r[1] and r[2]), 2):
        if a[1:3] == b[1:3]:
            g, h = grams(normal[a[0]]), grams(normal[b[0]])
            if round(len(g & h) / len(g | h), 6) >= 0.85:
                want[a[0], b[0]] = round(len(g & h) / len(g | h), 6)
    got = [((r.a_id, r.b_id), r.similarity) for r in relations.similar_names(df).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want and len({v for v in want.values()}) > 1


def test_pairs_of_ids_are_not_shuffled_or_compared(spark):
    df = spark.createDataFrame([(i, "w0", "a", f"Acme Tech {i % 3}") for i in range(3000)], COMPANY)
    found = relations.similar_names(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]  # what happens to pairs once they are made
    assert not any(x in above for x in ("Join", "Aggregate", "Repartition", "array_intersect"))
    assert found.count() >= 3 * 1000 * 999 // 2
