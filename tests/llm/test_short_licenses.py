"""Templates of one shingle are found at every place, also at the head of a text."""

from lacuna.llm import licenses


def test_one_shingle_templates_at_the_head_and_inside(spark):
    templates = {f"t{n}": f"released{n} under the own{n} license" for n in range(100)}
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(i % 2 * 9)), templates[f"t{i // 2 % 100}"], *(f"b{i}y{k}" for k in range(12))])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["license_id"], r["containment"], r["start_word"]) for r in licenses.scan(docs, templates).collect()}
    missed = [i for i, _ in rows if i not in found]
    assert not missed, f"{len(missed)} of {len(rows)} missed, {sum(i % 2 == 0 for i in missed)} at the head"
    assert found == {i: (f"t{i // 2 % 100}", 1.0, i % 2 * 9) for i, _ in rows}


def test_a_long_text_of_notices_is_scanned_in_windows(spark):
    """A text of 300,000 words with a notice at every thousandth: rows hold windows, and the first place is found."""
    notice = licenses.TEMPLATES["bsd"]
    text = " ".join([*[f"w{i}" for i in range(1000)], *[notice + " " + " ".join(["filler"] * 980)] * 300])
    rows = spark.createDataFrame([(1, text), (2, "nothing here"), (3, notice)], "doc_id long, text string")
    found = {(r["doc_id"], r["license_id"]): (r["containment"], r["start_word"]) for r in licenses.scan(rows).collect()}
    assert found == {(1, "bsd"): (1.0, 1000), (3, "bsd"): (1.0, 0)}
