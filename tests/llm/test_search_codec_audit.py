"""SentencePiece codes, ranked search and the filter audit against the library and brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import sentencepiece

from docstruct.llm import catalog, filteraudit, lexsearch, mergecodec

DATA = "/root/testdata/sf0.001"
PIECES = catalog.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    pieces = mergecodec.Pieces(PIECES)
    return mergecodec.Encoder(pieces), mergecodec.Decoder(pieces)


def test_ids_equal_the_library_on_odd_texts(library, codec):
    encoder, decoder = codec
    rng, names = random.Random(5), list(encoder.usable)
    texts = ["", " ", "\n", "\0", "▁ x", "a" * 3000, " " * 3000, "=-" * 2000, "日本語" * 500, "\r\n\t", "<s> </s> <0x0A> <unk>"]
    for n in range(4000):
        kinds = ("ab e\n▁é日<>", names, [chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0xD800), rng.randrange(0x1F300, 0x1F700)]))], "aeinstrl", ["aa", "a", " ", "  ", "the", "=", "==", "0", "00", "--"])
        texts.append("".join(rng.choice(kinds[n % 5]) for _ in range(rng.randrange(30))))
    for t in texts:
        ids, want = np.frombuffer(encoder.encode(t), "<u4").tolist(), library.encode(t, add_bos=True, add_eos=True)
        assert ids == want, t[:100]
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(want)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32_000), 0, 1, 2, rng.randrange(3, 259), 29871]) for _ in range(rng.randrange(9))]
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_a_failed_position_is_left_for_a_shorter_piece():
    class Toy:
        normal = {n: i for i, n in enumerate(["a", "b", "c", "d", "ab", "bc", "bcd"])}
        rank = {"bc": 0, "ab": 1, "bcd": 2} | {c: 9 for c in "abcd"}
        names, byte, unk = list(normal), {}, 99

    encoder = mergecodec.Encoder(Toy)
    for t in (t for n in range(1, 7) for t in map("".join, itertools.product("abcde", repeat=n))):
        want = []
        for run in re.split("(e)", t):
            want += [99] if run == "e" else [Toy.normal[x] for x in mergecodec.merged(list(run), Toy.rank)]
        assert encoder.walk(t) == want, t


def test_the_query_equals_the_library_and_general_columns(spark, library):
    docs = {r.doc_id: r.text or "" for r in catalog.documents(spark, DATA).collect()}
    got = catalog.op11_sentencepiece(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    frame = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, IDS string")
    out = mergecodec.encode(frame, PIECES)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens"]
    assert sorted((str(r.doc_id), r.ids) for r in out.collect()) == sorted([("1", library.encode("a b", add_bos=True, add_eos=True))] * 2 + [("None", [1, 2]), ("2", [1, 2])])
    back = mergecodec.decode(out.selectExpr("doc_id", "IF(doc_id = 2, NULL, ids) AS ids", "'z' AS Decoded"), PIECES)
    assert sorted((str(r.doc_id), r.decoded) for r in back.collect()) == [("1", "a b"), ("1", "a b"), ("2", None), ("None", "")]
    assert mergecodec.decode(mergecodec.encode(frame.where("false"), PIECES, packed=True), PIECES).count() == 0


def ranked(docs, items, top):
    """Every item against every document, as the contract says it."""
    terms = lambda t: re.findall(lexsearch.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(k, terms(t)) for k, t in docs]
    n_docs, n_all = sum(bool(ts) for _, ts in own), sum(len(ts) for _, ts in own)
    df = {}
    for _, ts in own:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    wanted = {}
    for name, t in items:
        wanted.setdefault(name, set()).update(terms(t))
    out = []
    for name, qs in wanted.items():
        rows = []
        for k, ts in own:
            m = 50 + (50 * len(ts) * n_docs) // n_all if n_all else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[q] + 1))) * (10**9 * ts.count(q) // (1000 * ts.count(q) + 20 * m)) for q in qs if q in ts)
            if score > 0:
                rows.append((-score, k is None, k or 0, k))
        out += [(name, n + 1, k, -s) for n, (s, _, _, k) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_search_equals_brute_force_on_awkward_rows(spark, block, monkeypatch):
    monkeypatch.setattr(lexsearch, "KEPT", 3)
    rng = random.Random(2)
    words = ["the", "The", "cat", "ÉTÉ", "été", "x1", "naïve", "日本", "a", "ab", "_", "$", "cat the"]
    docs = [(i, rng.choice([" ", "\n", "--"]).join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(300)]
    docs += [(i, "the cat ab") for i in range(400, 480)] + [(7, "the cat ab")] * 3 + [(None, "the cat ab"), (None, None), (900, None), (901, ""), (902, "cat " * 50_000)]
    items = [("q1", "the cat"), ("q1", "Ab!"), (None, "日本 été"), ("q2", ""), ("q3", None), ("q4", "nowhere"), ("q5", "a a a x1 the cat ab naïve")]
    frame = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, score string, _item int").repartition(5)
    wanted = spark.createDataFrame([(*r, "z") for r in items], "item_id string, text string, rank string")
    for top in (4, 1000):
        got = lexsearch.search(frame, wanted, top, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items, top)
    assert lexsearch.search(frame.where("false"), wanted).count() == lexsearch.search(frame, wanted.where("false")).count() == 0


def test_audit_equals_a_sequential_run_of_every_order(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "PARTS", 1)
    rng = random.Random(4)
    texts = ["", None, "word " * 120, " ".join(f"w{i}" for i in range(150)), " ".join(f"W{i}$" for i in range(150)), "AB cd", "É # x", " ".join(f"QQQQQ{i}" for i in range(130))]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(200)] + [(3, texts[3], "en"), (3, texts[3], "de"), (None, "AB cd", "en"), (None, None, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, "z", 1) for d in docs], "doc_id long, text string, lang string, part string, step int").repartition(4)
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))

    def failed(row):
        k, t = row[0], row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and k > least[t]}
        return {f for f, yes in out.items() if yes}

    judged = [(d, failed(d), any(x[0] == d[0] and x[1] == 1 for x in labels if d[0] is not None), any(x[0] == d[0] and x[2] == 1 for x in labels if d[0] is not None)) for d in docs]
    want = {}
    for part in {d[2] or "" for d in docs}:
        rows, removals = [j for j in judged if (j[0][2] or "") == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(rows)
            for n, f in enumerate(order):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                removals[f] += len(gone)
                want[part, order, n + 1] = [len(left), len(gone), sum(f in j[1] for j in rows) - len(gone), sum(j[1] == {f} for j in rows), sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, n), v in want.items():
            if p == part:
                v.append(removals[order[n - 1]])
    got = filteraudit.audit(frame, marks)
    assert got.columns == ["part", "filter_order", "step", *filteraudit.OUTCOMES, "shapley"]
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == want and got.count() == len(want)
    assert filteraudit.audit(frame.where("false"), marks).count() == 0
    assert {r.kept for r in filteraudit.audit(frame, marks.where("false")).collect()} <= {v[0] for v in want.values()}
    # fields neither meet nor overflow
    code = 0b0000110
    fields = filteraudit.unpacked(filteraudit.packed(code) * (2**63 - 1))
    assert fields.min() == 0 and fields.max() == 2**63 - 1 and ((fields == 0) | (fields == 2**63 - 1)).all()
