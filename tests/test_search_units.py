"""Search reads documents as they lie; the hashed embedding of many texts against a plain loop."""

import hashlib

import numpy as np

from lacuna.operators import tfidf
from lacuna.operators import vectors as E
from lacuna.plans import retrieval_queries as Q

SF = "/root/testdata/sf0.001"


def test_units_of_the_search_are_no_join_of_texts(spark, monkeypatch):
    taken = []
    find = tfidf.search_evidence
    monkeypatch.setattr(tfidf, "search_evidence", lambda method, units, *a, **b: taken.append(units) or find(method, units, *a, **b))
    Q.e14(spark, SF)
    assert len(taken) == 2
    assert all("Join" not in u._jdf.queryExecution().optimizedPlan().toString() for u in taken)


def test_hashed_rows_are_those_of_a_plain_loop():
    texts = ["A word of some words a word of", None, "", "word", " İs  x y z ", "A word of some words a word of"]
    want = np.zeros((len(texts), 384))
    number = lambda digest, t: int(digest(t.encode()).hexdigest()[:8], 16) % 384
    for out, text in zip(want, texts):
        words = (text or "").lower().split()
        for i, w in enumerate(words):
            out[number(hashlib.sha256, w)] += 1.5 / (1 + 0.05 * i)
            if len(w) > 3:
                out[number(hashlib.md5, w[:4])] += 0.75 / (1 + 0.05 * i)
            if i:
                out[number(hashlib.sha256, f"{words[i - 1]}_{w}")] += 2.0 / (1 + 0.05 * i)
        out /= max(np.linalg.norm(out), 1e-300)
    got = E.hashed_rows(texts)
    assert np.allclose(got, want, rtol=0, atol=1e-14) and not got[1].any() and not got[2].any()
    assert (got[0] == got[5]).all()
    assert E.hashed_rows([None, ""]).shape == (2, 384)
