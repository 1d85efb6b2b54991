"""Languages with fewer documents than a reference in the plan takes."""

import random

from vetframe.llm import quality

from .conftest import SCHEMA, prose

CYRILLIC = str.maketrans("abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшхыз")


def test_clean_texts_of_a_rare_script_stay(spark):
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 80, "xx"), "xx", "s0", 0) for i in range(600)]
    rows += [(1000 + i, prose(rnd, 80, "xx").translate(CYRILLIC), "ru", "s0", 0) for i in range(4)]
    rows += [(2000, " ".join("#*$%" for _ in range(80)) + " 1", "ru", "s0", 0), (2001, prose(rnd, 80, "xx").translate(CYRILLIC), None, "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert len(got) == len(rows) and all(got[1000 + i]["kept"] for i in range(4)) and not got[2000]["kept"]
    assert all(got[i]["kept"] for i in range(600)) and not got[2001]["kept"]
    kept = quality.drop_poor(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}
