import random
import re
import zlib

import numpy as np

from pointweave.llm import html, pii, toxicity
from tests.llm.helpers import SCHEMA, collected, odd_documents, words


def brute_spans(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_patterns_equal_the_plain_expressions():
    r = random.Random(1)
    letters = "aB@@..--++ ()1234567890125%_é"
    for _ in range(20_000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("1" * 20_000 + "a@" * 5000) == []  # long runs stay linear


def test_field_learns_its_table_and_finds_more():
    model = pii.default_model()
    rows = pii.parse_labelled()
    paths = model.viterbi([np.array([pii.shape(t) for t in tokens]) for tokens, _ in rows])
    right = sum((p == np.array(y)).sum() for p, (_, y) in zip(paths, rows, strict=True))
    assert right / sum(len(y) for _, y in rows) > 0.98
    texts = ["call 212-555-0188 today", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "write to kim (at) example (dot) org now", "in 1998 there were 250 of 1000 people", ""]
    added = [[k for *_, k in spans] for _, spans in pii.find(texts, model)]
    assert added == [["phone"], ["secret"], ["email"], [], []]


def test_viterbi_equals_enumeration():
    import itertools

    r = np.random.default_rng(0)
    k = len(pii.LABELS)
    model = pii.CRF(r.normal(size=(5 * pii.N_SHAPES, k)), r.normal(size=(k, k)), r.normal(size=k))
    for chain in ([], [3], [5, 80, 2, 44]):
        shapes = np.array(chain, np.int64)
        (path,) = model.viterbi([shapes])
        if not chain:
            assert not len(path)
            continue
        local = model.weights[pii.features(shapes)].sum(axis=1)
        value = lambda y: model.first[y[0]] + sum(local[i, v] for i, v in enumerate(y)) + sum(model.moves[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(path) == max(itertools.product(range(k), repeat=len(chain)), key=value)


def test_tagging(spark):
    rows = odd_documents(spark)
    got = collected(pii.tag(rows))
    assert len(got) == rows.count()
    own = next(r for r in got if r["doc_id"] == 11)
    assert (own["n_email"], own["n_ip"], own["n_card"], own["n_phone"]) == (1, 1, 1, 1)
    text = next(r["text"] for r in collected(rows) if r["doc_id"] == 11)
    assert own["spans"] == pii.written(brute_spans(text))
    masked = {r["doc_id"]: r for r in collected(pii.masked(rows))}
    assert "<EMAIL>" in masked[11]["text"] and "555" not in masked[11]["text"] and masked[11]["n_chars"] == len(masked[11]["text"])
    assert masked[3]["text"] is None and masked[6]["text"] == "one two"
    assert pii.tag(rows.where("false")).count() == 0


def test_folding():
    assert toxicity.fold("You IDIOT!! st​up1d, іdіot m0r0n l@ser") == " you idiot stupid idiot moron laser "
    assert toxicity.fold("") == "  "


def _labelled(n):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        w = words(60, i).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zorgish", "blarpy", "idiot", "1d1ot"])
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = _labelled(600)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows] + [(9001, None, None, None, None), (9002, "", None, None, None), (None, "a trash can", None, None, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in collected(toxicity.score(docs, model).withColumn("held", toxicity.held_out()))}
    assert len(got) == 603
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held == [i for i, _, _ in rows if got[i]["held"]]
    assert sum(got[i]["predicted"] == rows[i][2] for i in held) / len(held) > 0.97
    assert got[9001]["predicted"] == got[9002]["predicted"] == got[None]["predicted"] == 0
    assert toxicity.train(docs, labels.where("false")).weights and toxicity.score(docs.where("false"), model).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>x</p>";</script><style>p{{}}</style></head><body class="home"><header>Site</header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><article><h1>{title} &amp; more</h1>
<p>First{i}&nbsp;<b>bold</b>  text<br>goes
on<p>Second {i}</p><aside>Side</aside><form><input> Subscribe</form><div class="ad">Buy</div></article><section id="comments"><article class="comment"><p>Bad</p></article></section><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(title=f"Title {i}", i=i)) for i in range(30)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://h0.example/cut", "<body><nav>n</nav><article><p>Cut <b"), (103, "http://h9.example", "plain text"), (7, "http://h1.example/7", rows[7][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", html.host()).withColumn("part", html.host())
    got = collected(html.extract(df))
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i in range(30):
        assert by[i]["text"] == f"Title {i} & more\n\nFirst{i} bold text goes on\n\nSecond {i}" and by[i]["n_chars"] == len(by[i]["text"])
    assert (by[100]["text"], by[101]["text"], by[102]["text"], by[103]["text"]) == ("", "", "Cut", "plain text")
    assert html.extract(df.where("false")).count() == 0


def test_field_reads_every_token():
    model = pii.default_model()
    (_, spans), (_, upper) = pii.find(["no sign near, write to kim ( at ) example ( dot ) org today", "write to kim [AT] example [DOT] org today"], model)
    assert [k for *_, k in spans] == ["email"] and len(pii.chain("a b, c_d")) == 6
    text = "the number 212-555-0188 is ours"
    shapes = [pii.chain(x) for x in (text, "", "one two", text * 3)]
    assert [p.tolist() for p in model.viterbi(shapes)] == [model.viterbi([c])[0].tolist() for c in shapes]


def test_long_texts_stay_linear():
    model = pii.default_model()
    for t in ("a (at) b " * 20_000, "call 212-555-0188 or a@b.cd now " * 10_000, "1-" * 100_000, "x" * 300_000):
        ((own, spans),) = pii.find([t], model)
        assert len(spans) >= len(own)
    lexicon = toxicity.Model({" trash ": 1.0, " idiot ": 2.0}, ("trash can",), (0.0, 0, 1, 0, 0, 0))
    s = toxicity.fold("trash can idiot " * 60_000)
    assert abs(lexicon.features(s)[2] - np.log1p(120_000)) < 1e-9


def test_lexicon_matches_equal_brute_force():
    r = random.Random(9)
    weights = {" ab ": 1.0, " abc": 2.5, " ca ": 0.5, " b ": 4.0}
    model = toxicity.Model(weights, ("ab ca", "x b", "b ab"), (0.0,) * 6)
    for _ in range(3000):
        s = toxicity.fold(" ".join(r.choice(["ab", "abca", "abc", "ca", "b", "x", "abd"]) for _ in range(r.randint(0, 12))))
        off = [(i, i + len(e) + 1) for e in model.exceptions for i in range(len(s)) if s.startswith(f" {e} ", i)]
        total, last = 0.0, -1
        for a, b, w in sorted((i, i + len(k) - 1, w) for k, w in weights.items() for i in range(len(s)) if s.startswith(k, i)):
            if a > last and not any(x <= a and b <= y for x, y in off):
                total, last = total + w, a
        assert abs(model.features(s)[2] - np.log1p(total)) < 1e-12


def test_training_bounds(spark):
    rows = _labelled(200)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows for _ in range(2)] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.train(docs, labels) == toxicity.train(docs, labels.distinct())
    assert toxicity.train(docs, labels, most_chars=10).coefficients == (-5.0, 3.0, 1.0, 0.5, 0.0, 0.0)


def test_pieces_give_the_whole_path(monkeypatch):
    r = np.random.default_rng(1)
    k = len(pii.LABELS)
    model = pii.CRF(r.normal(size=(5 * pii.N_SHAPES, k)), 2 * r.normal(size=(k, k)), r.normal(size=k))
    chains = [r.integers(0, pii.N_SHAPES, n) for n in (0, 1, 7, 100, 33, 0, 64, 250, 8)]
    want = model.viterbi(chains)
    for piece, warm in ((8, 1), (5, 3), (64, 2), (1, 1)):
        monkeypatch.setattr(pii, "PIECE", piece)
        monkeypatch.setattr(pii, "WARM", warm)
        got = model.viterbi(chains)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_slices_of_texts(monkeypatch):
    monkeypatch.setattr(pii.common, "SLICE_BYTES", 10)
    assert list(pii._slices(["a" * 4, None, "b" * 6, "c", "d" * 50, ""])) == [3, 1, 1, 1] and list(pii._slices([])) == [] and list(pii._slices(["x"] * 5, 2)) == [2, 2, 1]
