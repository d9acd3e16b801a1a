import random

from tidewheel.llm import pages

PROSE = "We load the record from the archive and keep all rows with a local panel. After cleaning, every sample in the panel is one of the heavy ones, so the mean stays within the limits. If the network shows too quickly, lower the level and run the cell again. "


def corpus():
    rng = random.Random(3)
    nouns = ["record", "panel", "kettle", "tram", "reef", "label", "orchard", "kiln", "sample", "index", "ledger", "pollen"]
    good = []
    for i in range(60):
        text = "\n\n".join(" ".join(f"The {rng.choice(nouns)} of {rng.choice(nouns)} {rng.randint(1, 99)} is in the {rng.choice(nouns)} and we keep it with a {rng.choice(nouns)}." for _ in range(rng.randint(2, 5))) for _ in range(4))
        good.append((i, text + "\n\nIn [1]:\nx = data.groupby('level')['score'].mean()\nprint(x[3], y(4))", "en"))
    stuffed = lambda: " ".join(rng.choice(["cheap", "watch", "buy", "sale"]) for _ in range(150))
    spam = [
        (100, stuffed(), "en"), (101, PROSE + "\n\n" + stuffed() + "\n\n" + stuffed(), None),
        (102, "\n".join(f"http://a{i}.test/b_{i}" for i in range(30)), "en"), (103, "\n\n".join(f'<a href="http://a{i}.test/x">buy watch</a><br>' for i in range(30)), "en"),
        (104, " ".join(f"#sale{rng.choice('abcdef')}x" for _ in range(60)), "xx"), (105, "\n".join(f"Watch AB-{i} | new $1{i}.50" for i in range(30)), "en"),
        (106, '{"cells": [{"cell_type": "markdown", "source": ["' + stuffed() + '"]}]}', "en"), (107, "<ul>" + "".join(f"<li>{rng.choice(['buy watch', 'top sofa'])}</li>" for _ in range(60)) + "</ul>", "en"),
    ]
    fine = [
        (200, PROSE * 3 + "\n\n" + " ".join(["label"] * 30), "en"), (201, "\n".join(f"[{i}] {PROSE} http://a.test/{i}" for i in range(5)), "en"), (202, "", "en"), (203, None, None), (204, " \n ", "en"),
        (205, "iVBORw0KGgo" + "".join(rng.choice("abcXYZ0123+/") for _ in range(3000)), "en"), (206, '{"cells": broken \\n x', "en"), (207, "x" * 100_000, "en"),
    ]
    return good, spam, fine


def test_found(spark):
    good, spam, fine = corpus()
    df = spark.createDataFrame([(*r, 1.0) for r in good + spam + fine + spam[:1]], "doc_id bigint, text string, lang string, spam double")
    got = {r["doc_id"]: r for r in pages.spam_pages(df).collect()}
    assert set(got) == {r[0] for r in good + spam + fine}
    assert {d for d, r in got.items() if r["spam"]} == {r[0] for r in spam}, {d: r["spam_share"] for d, r in got.items() if r["spam"] != (100 <= d < 200)}
    assert got[202]["spam_share"] == got[203]["spam_share"] == got[204]["spam_share"] == 0


def test_empty(spark):
    assert pages.spam_pages(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0


def test_curve_matches_numpy(spark):
    import numpy as np

    rows = [(1, 1, 0, "en", 10, 10, 0.0, 0.0, 0.0, False, False, [(1, 3), (5, 1), (2, 1)])] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, " + pages._SCHEMA)
    (r,) = pages.fitted_curves(df).collect()
    x = np.log([1, 2, 4, 4, 4])
    y = np.log([5, 2, 1, 1, 1])
    b, a = np.polyfit(x, y, 1)
    assert abs(r["slope"] - b) < 1e-9 and abs(r["residual"] - np.sqrt(np.mean((y - a - b * x) ** 2))) < 1e-9
    assert (r["d"], r["c1"], r["c2"], r["c4"], r["c8"], r["c64"]) == (5, 0.5, 0.7, 0.9, 1.0, 1.0)


def test_tokens():
    found, marks = pages.tokens("[Buy](http://a.test/x) one #Sale, [sofa] EUR 12.50 <b>(3)</b> 'http://b.test' 你好 <a href=\"http://c.test\">")
    count = {t: found.count(t) for t in found}
    assert count == {pages.LINK: 2, pages.LABEL: 2, pages.PRICE: 1, "buy": 1, "one": 1, "sale": 1, "sofa": 1, "3": 1, "你": 1, "好": 1} and marks == 4
    assert pages.tokens("for i in 1:46 frame[i] = grid[i] / 2.5, end")[0] == ["for", "i", "in", "1", "46", "frame", "i", "grid", "i", "2.5", "end"]
    assert pages.tokens("Für (x) = 3,5. 你好") == (["für", "x", "3,5", "你", "好"], 3)


def test_keywords_among_numbers_and_brackets(spark):
    """No digit or bracket keeps keywords from being found; code and output with the same marks aren't spam."""
    rng = random.Random(8)
    good, _, _ = corpus()
    words = [rng.choice(["cheap", "watch", "buy", "sale"]) for _ in range(150)]
    numbered = lambda k: " ".join(w + (f" {rng.randint(10, 99)}" if i % k == k - 1 else "") for i, w in enumerate(words))
    boxed = " ".join(f"[{w}]" if i % 8 == 7 else w for i, w in enumerate(words))
    plain = " ".join(words)
    log = lambda n: "\n".join(f"Epoch {i}/{n} - loss: {rng.random():.4f} - acc: {rng.random():.4f} - {rng.randint(1, 90)}s" for i in range(n))
    code = lambda: "\n".join(f"{rng.choice(['x', 'rows', 'y'])}['{rng.choice(['level', 'score', 'zone'])}'] = f({rng.choice(['x', 'y'])}, {rng.randint(1, 99)})" for _ in range(20))
    more = [(400 + i, f"In [1]:\n{code()}\n\nOut[1]:\n{log(rng.randint(4, 30))}", "en") for i in range(40)]
    spam = [(300, plain, "en"), (301, numbered(6), "en"), (302, numbered(12), "en"), (303, boxed, "en")]
    df = spark.createDataFrame(good + more + spam, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["spam_share"] for r in pages.spam_pages(df).collect() if r["spam"]}
    assert set(got) == {r[0] for r in spam}, got


def test_one_sentence_over_and_over(spark):
    """Only the curve over the whole page shows that its paragraphs are all the same."""
    rng = random.Random(4)
    nouns = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(900)]
    say = lambda: f"The {rng.choice(nouns)} of the {rng.choice(nouns)} is {rng.choice(nouns)} and we keep it with a {rng.choice(nouns)} for {rng.choice(nouns)} {rng.choice(nouns)}."
    good = [(i, "\n\n".join(say() for _ in range(rng.randint(14, 19))), "en") for i in range(150)]
    spam = [(300, "\n\n".join(["Buy cheap designer watches online today, best price and free shipping now!"] * 40), "en")]
    got = {r["doc_id"] for r in pages.spam_pages(spark.createDataFrame(good + spam, "doc_id bigint, text string, lang string")).collect() if r["spam"]}
    assert got == {300}


def test_curve_decides(spark):
    """Without the limits on the curve, only the pages of links, prices and labels are left."""
    good, spam, fine = corpus()
    df = spark.createDataFrame(good + spam + fine, "doc_id bigint, text string, lang string")
    was = pages.STEEP, pages.LOOSE, pages.FAR, pages.ALONE
    try:
        pages.STEEP = pages.LOOSE = pages.FAR = pages.ALONE = 1e9
        got = {r["doc_id"] for r in pages.spam_pages(df).collect() if r["spam"]}
    finally:
        pages.STEEP, pages.LOOSE, pages.FAR, pages.ALONE = was
    assert got == {102, 103, 104, 105, 107}


def test_blocks():
    assert pages.blocks("# %% [markdown]\n# ## Title\n#\n# Some text.\n\n# %% [1]\nx = 1\n") == ["Title", "Some text.", "x = 1"]
    assert pages.blocks("In [1]:\nx\n\nOut[1]:\ny") == ["x\ny"]


def test_blocks_of_json_with_odd_spaces():
    page = '\ufeff{\u00a0"cells":\u200b [{"cell_type": "markdown", "source": ["buy\u00a0one", " two"]}]}'
    assert pages.blocks(page) == ["buy one two"]
    assert pages.blocks('{"cells": [{"cell_type": "markdown", "source": ["a\u00a0b"]}]}') == ["a\u00a0b"]


def test_keywords_beside_data_are_read(spark):
    good, spam, _ = corpus()
    run = "iVBORw0KGgo" + "abcXYZ0123+/" * 10
    df = spark.createDataFrame([*good, (300, spam[0][1] + " " + run + " " + spam[0][1], "en"), (301, run * 9, "en")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["spam"] for r in pages.spam_pages(df).collect()}
    assert got[300] and not got[301]


def test_two_bracket_labels_are_listed(spark):
    good, _, _ = corpus()
    df = spark.createDataFrame([*good, (300, "[mattress] [sofa]", "en"), (301, "[mattress](a) [1]", "en")], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r["spam"] for r in pages.spam_pages(df).collect()}
    assert got[300] and not got[301]
