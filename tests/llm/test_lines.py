import random

from wayfind.llm import line_dedup as L


def test_near_copies_are_not_all_paired(spark, monkeypatch):
    r = random.Random(11)
    base = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join([*base[:20], f"own{i}", *base[21:]]) + "\n" + " ".join(r.choices("abcdefghijklmnop", k=12))) for i in range(400)]
    docs, counts = spark.createDataFrame(rows, "doc_id long, text string"), []
    stored = L._stored

    def counting(df, name):
        out = stored(df, name)
        counts.append((name, out.count()))
        return out

    monkeypatch.setattr(L, "_stored", counting)
    gone = {x["doc"] for x in L.matched_lines(docs).where("line = 0").collect()}
    assert gone == set(range(1, 400))
    assert sum(n for name, n in counts if name == "pairs") < 4000
