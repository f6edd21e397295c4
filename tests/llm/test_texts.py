"""Decontamination, quality rules, extraction, and the learned models."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from hitledger.llm import decontamination, html_text, language, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(3)
    for _ in range(300):
        p = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        most, best = rng.randint(0, 30), slow_distance(p, t)
        got = decontamination.nearest(p, t, most)
        assert (got[0] if got else None) == (best if best <= most else None)


def test_every_item_within_the_budget_is_found(prose):
    rng = random.Random(4)
    items = [(i, prose(i, 30, 1)) for i in range(8)]
    index = decontamination.PieceIndex(items, 0.08)
    for n in range(120):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 20)):
            k, what = rng.randrange(len(text)), rng.random()
            text[k : k + (what < 0.7)] = "" if what < 0.4 else rng.choice("xyz")
        whole = f"{prose(n + 100, 40)}  {''.join(text).upper()}\n{prose(n + 300, 40)}"
        got = {m[0]: m for m in index.matches(whole)}
        for i, item in items:
            plain = decontamination.normal(item)
            best = slow_distance(plain, decontamination.normal(whole))
            assert (i in got) == (best <= int(len(plain) * 0.08))
            if i in got:
                assert got[i][1] == best
                assert slow_distance(decontamination.normal(whole[got[i][2] : got[i][3]]), plain) <= best


def test_items_in_blocks(documents_of, spark, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    items = spark.createDataFrame([(i, prose(i, 30, 1)) for i in range(8)], "item_id bigint, text string")
    docs = documents_of([(i, f"{prose(50 + i)}\n{prose(i, 30, 1)}\n{prose(80 + i)}" if i % 2 else prose(50 + i)) for i in range(8)])
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.find_items(docs, items).collect()) == [(i, i, 0) for i in (1, 3, 5, 7)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [0, 2, 4, 6]


def slow_measures(text):
    words, again = text.encode().split(), set()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            again |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def test_base_measures(documents_of, prose):
    rng = random.Random(6)
    texts = ["", "a", " \n ", "é É x 日本", "a b c d e f g h " * 3, "x\nx\ny\n\n\nx", "#*$ <a> b&c", prose(1), prose(2, 30) + "\n" + prose(2, 30)]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(20)]
    got = {r.doc_id: r for r in quality.assess(documents_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r, (n, chars, symbols, lines, again) = got[i], slow_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, again)
        assert r.base_failed == (n < 20 or 100 * again > 30 * n)


def test_order_of_rules_changes_nothing(prose):
    rng = random.Random(8)
    texts = [t.encode() for t in (prose(1), "SHOUTING LOUD " * 20, "a | b | c | " * 20, "word " * 40, "", "## ** " * 30, prose(2, 200))]
    rules = [*quality.BASE_RULES, *quality.RULES]
    want = quality.cascade(quality.Texts(texts), rules).tolist()
    assert want == [True, False, False, False, False, False, True]
    for _ in range(10):
        rng.shuffle(rules)
        assert quality.cascade(quality.Texts(texts), rules).tolist() == want
    cheap = quality.measured_order(texts, rules)
    assert {r.name for r in cheap} == {r.name for r in rules} and cheap[-1].rejects(quality.Texts(texts)).mean() <= 0.6


@pytest.mark.parametrize(
    "source,text",
    [
        ("plain text, no tags", "plain text, no tags"),
        ("<p>a<script>x</p>", "a"),
        ("<table><tr><td>x<td>y</table> 3 < 4 and <b>5</b>>2", "x\ny\n3 < 4 and 5>2"),
        (
            '<html><head><title>T</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, ok.</div>'
            '<div class="content"><h2>Head</h2><p>Hello &amp;amp; bye,\n x&nbsp;y.</p><ul><li>a<li>b</ul><div class="comments"><p>First! I like it, very much.</p></div></div>'
            '<aside>x, y, z</aside><form>Mail, please: <input></form></body></html>',
            "Head\nHello &amp; bye, x y.\na\nb",
        ),
        ("<nav>Home, News</nav><article><h1>One</h1><p><b>Bold. <br><p>Two, <i>th</i>ree.</article><footer>&copy; me, 2024.</footer>", "One\nBold.\nTwo, three."),
        ("<nav>only</nav><style>p{}</style>", ""),
        ('<article><header><h1>Title</h1></header><p title="a>b">Text, more.</p><!-- no <p>x</p> --></article>', "Title\nText, more."),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source) == text


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "deep, text." + "</div>" * 3000) == "deep, text."
    assert html_text.main_text("<p>a, b.</p>" * 3000) == "\n".join(["a, b."] * 3000)
    assert html_text.main_text('<a href="' + "x" * 100_000) is not None


def labelled(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_language_of_held_out_texts(spark):
    from hitledger.llm.queries import op10_language_id

    found = op10_language_id(spark, FOLDER)
    docs, _ = labelled(spark)
    held = found.filter("held_out").join(docs, "doc_id").selectExpr("lang_pred = lang AS good", "score").collect()
    assert len(held) > 200 and sum(r.good for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in held)


def test_language_ignores_batching_and_length():
    model = language.train({"en": ["the cat and the dog that is in this house with all of them"] * 4, "de": ["der hund und die katze sind nicht in diesem haus mit allen"] * 4})
    texts = ["the dog and the cat", "die katze und der hund", "", "12 ?", "The house. " * 5000]
    names, scores = model.score(texts)
    assert names == ["en", "de", "und", "und", "en"]
    for t, n, s in zip(texts, names, scores):
        alone = model.score([t])
        assert alone[0] == [n] and abs(alone[1][0] - s) < 1e-6


def test_toxicity_of_held_out_texts(spark):
    from hitledger.llm.queries import op3_toxicity

    found = op3_toxicity(spark, FOLDER)
    _, labels = labelled(spark)
    held = found.filter("held_out").join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    caught = sum(r.toxic and r.predicted for r in held)
    assert caught >= 0.6 * sum(r.toxic for r in held) and sum(r.predicted for r in held) <= caught + 2
    assert all(0 <= r.score <= 1 for r in held)


def test_toxic_windows():
    seen = [(f"you idiot number{i} fine", 1) for i in range(12)] + [(f"you are fine number{i}", 0) for i in range(100)]
    model = toxicity.train(seen, [("such an idiot", 1), ("such a day", 0)] * 8, 0.1)
    assert [w for w, _ in model.windows("An IDIOT, idiotic and fine")] == ["idiot"]
    assert model.score("idiot") > 0.7 > 0.3 > model.score("fine") == model.score("")


@pytest.mark.parametrize("name", ["op2_sharding", "op4_line_dedup", "op5_html_extraction", "op7_quality_cascade"])
def test_queries_equal_their_sql(spark, name):
    from hitledger.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall(), key=str)


def test_toxicity_is_learnt_from_whole_texts(spark):
    """Every toxic word stands behind 20,000 characters of its text, in the rows for words and for calibration."""
    plain = "such a fine day to you " * 1000
    rows = [(i, plain + (f"idiot number{i}" if i % 8 < 2 else f"fine number{i}")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 8 < 2)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, F.col("id") % 2 == 0, F.col("id") % 2 == 1)
    assert [w for w, _ in model.windows("an idiot and fine")] == ["idiot"]
    assert model.score("you idiot") > 0.7 > 0.3 > model.score("such a day")


def test_toxicity_fits_tables_as_it_trains_lists(spark):
    texts = [(f"you idiot number{i} fine", 1) for i in range(12)] + [(f"you are fine number{i}", 0) for i in range(100)]
    seen = [*texts, texts[0], (texts[1][0], 0)]  # a copy, and a text with both labels
    unseen = [("such an idiot", 1), ("such a day", 0)] * 8 + [("such a day", 1)]
    both = [(i, t, y) for i, (t, y) in enumerate(seen + unseen)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in both], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in both], "doc_id bigint, toxic int")
    fitted = toxicity.fit(docs, labels, F.col("id") < len(seen), F.col("id") >= len(seen))
    trained = toxicity.train(seen, unseen, fitted.prior)
    assert (fitted.ordinary, fitted.toxic, fitted.explained, fitted.gain) == (trained.ordinary, trained.toxic, trained.explained, trained.gain)
    assert all(abs(a - b) < 1e-9 for a, b in zip(fitted.weights, trained.weights))
