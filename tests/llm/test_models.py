import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import lm_score, toxicity


def _plain_kernel(s, t, n, decay):
    def weights(x):
        out = {}
        for c in combinations(range(len(x)), n):
            u = "".join(x[i] for i in c)
            out[u] = out.get(u, 0.0) + decay ** (c[-1] - c[0] + 1)
        return out

    a, b = weights(s), weights(t)
    return sum(w * b.get(u, 0.0) for u, w in a.items())


def test_kernel_sums_over_subsequences():
    rng = random.Random(1)
    s = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    t = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    for n in (2, 3, 4):
        got = toxicity.kernel(toxicity._codes(s), toxicity._codes(t), n, 0.7)
        assert got == pytest.approx([_plain_kernel(a, b, n, 0.7) for a, b in zip(s, t, strict=True)])


def _labelled(n=600, seed=2):
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "ans", "vo", "qui", "sta", "ne", "bor"]
    bad = ["grumblor", "snazzig", "vilterk"]
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ka", "mi"]))
        rows.append((k, " ".join(words[:len(words) // 2]) + ". " + " ".join(words[len(words) // 2:]), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic_model(llm_spark, make_docs):
    rows = _labelled()
    labels = llm_spark.createDataFrame([(i, 1, y, "x") for i, _, y in rows], "doc_id long, quality int, toxic int, text string")
    docs = make_docs([(i, t) for i, t, _ in rows])
    return rows, docs, toxicity.fit(docs, labels)


def test_held_out_accuracy(toxic_model):
    rows, docs, model = toxic_model
    want = {i: y for i, _, y in rows}
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_letters_put_in_between(toxic_model):
    scorer = toxicity.Scorer(toxic_model[2])
    seen = ["ka lo grumxblor mi", "ka snaz-zig lo", "ka v i l t e r k lo", "ka G.R.U.M.B.L.O.R lo"]
    assert all(toxic_model[2].probability(m) >= 0.5 for m in scorer.margins(seen))
    assert all(toxic_model[2].probability(m) < 0.5 for m in scorer.margins(["", "ka lo mi", "x" * 5000, "grum"]))


def test_odd_rows_and_rejection(make_docs, toxic_model):
    model = toxic_model[2]
    rows = [(1, None), (2, ""), (3, "such a grumblor it is"), (3, "such a grumblor it is"), (None, "ka"), (4, "ka " * 50_000)]
    got = {r["doc_id"]: r for r in toxicity.score(make_docs(rows), model).collect()}
    assert got[1]["score"] == got[2]["score"] < 0.5 <= got[3]["score"] and not got[None]["held_out"]
    kept = toxicity.reject(make_docs(rows), model)
    assert kept.columns == make_docs(rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "4", "None"]
    assert toxicity.score(make_docs([]), model).count() == 0


def test_without_labels_nothing_is_toxic(llm_spark, make_docs):
    none = llm_spark.createDataFrame([], "doc_id long, toxic int")
    docs = make_docs([(1, "any"), (2, "text")])
    assert {r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0}


def test_gradient_is_that_of_the_loss():
    net = lm_score.Network.fresh()
    ids = np.random.default_rng(1).integers(0, lm_score.IDS, 60)
    context, target = lm_score.windows([ids[:40], ids[40:]])
    _, seen = net.forward(context, target)
    for part, g in zip(net.parts(), net.gradient(context, seen), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = part[at], 1e-2
        sides = []
        for s in (step, -step):
            part[at] = old + s
            sides.append(-float(net.forward(context, target)[0].mean()))
        part[at] = old
        assert g[at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=0.02)


def test_windows_stay_in_their_document():
    context, target = lm_score.windows([np.array([1, 2]), np.array([], int), np.array([3])])
    edge = lm_score._EDGE
    assert target.tolist() == [1, 2, 3]
    assert context.tolist() == [[edge] * 3 + [2, edge, edge], [edge, edge, 1] + [edge] * 3, [edge] * 6]


def test_order_of_words_counts(llm_spark, make_docs):
    rng = random.Random(3)
    cycle = ["the", "small", "cat", "sat", "on", "a", "mat"]
    rows = [(k, " ".join(cycle * rng.randint(3, 30))) for k in range(200)] + [(500, None), (501, " "), (502, "solo"), (502, "solo")]
    docs = make_docs(rows)
    model = lm_score.fit(docs, rounds=(2, 1))
    again = lm_score.fit(docs, rounds=(2, 1))
    assert model.vocabulary == again.vocabulary
    shuffled = list(cycle * 8)
    rng.shuffle(shuffled)
    test = make_docs([(1, " ".join(cycle * 8)), (2, " ".join(shuffled))])
    means = {r["doc_id"]: r["mean"] for r in lm_score.score(test, model).collect()}
    assert means[1] > means[2] + 0.3
    got = {r["doc_id"]: r for r in lm_score.score(docs, model).collect()}
    assert (got[500]["score"], got[500]["mean"], got[501]["n_tokens"]) == (0.0, None, 0)
    words, net = lm_score.Vocabulary(model.vocabulary), lm_score.Network.unflat(model.flat)
    for i, t in rows[:20]:  # one by one, as a sum over positions
        ids = words.ids(t)
        padded = np.concatenate([np.full(3, lm_score._EDGE), ids, np.full(3, lm_score._EDGE)])
        one = sum(float(net.forward(padded[None, [k, k + 1, k + 2, k + 4, k + 5, k + 6]], ids[k:k + 1])[0][0]) for k in range(len(ids)))
        assert got[i]["score"] == pytest.approx(one, rel=1e-4)
    assert lm_score.score(make_docs([]), model).count() == 0


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, None)])
    assert lm_score.score(docs, lm_score.fit(docs)).first()["score"] == 0.0


def test_words_that_share_an_id_have_their_own_part_of_it(llm_spark, make_docs):
    rng = random.Random(4)
    rare = [f"r{k}" for k in range(2500)]
    rows = [(k, " ".join(rng.choices(rare, [1 / (1 + i) for i in range(2500)], k=60))) for k in range(150)]
    docs = make_docs(rows)
    counts = {}
    for _, t in rows:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    text = rows[0][1] + " qzxv " + " ".join(w for w in list(counts)[-40:])
    test = make_docs([(1, text), (1, text), (2, "qzxv"), (3, None)])
    for held in (0, 100):
        model = lm_score.fit(docs, rounds=(1,), held=held)
        assert len(model.vocabulary) == 768 < len(counts) and len(model.held) <= held
        words, net = lm_score.Vocabulary(model.vocabulary), lm_score.Network.unflat(model.flat)
        bucket, once = {}, {}
        for w, n in counts.items():
            i = int(words.ids(w)[0])
            bucket[i], once[i] = bucket.get(i, 0) + n, once.get(i, 0) + (n == 1)

        def plain(t):
            total = lm_score.log_probabilities(net, [words.ids(t)])[0]
            for w in t.split():
                i = int(words.ids(w)[0])
                if i >= 768:
                    whole = bucket[i] + once[i] + 1
                    total += np.log(counts[w] / whole) if w in counts else np.log((once[i] + 1) / whole) - 5 * np.log(257)
            return total

        got = sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in lm_score.score(test, model).collect())
        assert [g[:2] for g in got] == [(1, len(text.split()))] * 2 + [(2, 1), (3, 0)]
        assert [g[2] for g in got] == pytest.approx([plain(text), plain(text), plain("qzxv"), 0.0], rel=1e-4)


def test_texts_are_read_twice_whatever_the_rounds(llm_spark, make_docs):
    read = llm_spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = [(k, f"the {k % 7} cat sat on mat{k}") for k in range(40)]
    docs = make_docs(rows).withColumn("text", counted("text"))
    model = lm_score.fit(docs, rounds=(2, 1, 1))
    own = sorted((r["doc_id"], r["score"]) for r in lm_score.score(docs, model).collect())
    assert read.value == 2 * len(rows)  # to count words, and to make ids of them
    other = sorted((r["doc_id"], r["score"]) for r in lm_score.score(make_docs(rows), model).collect())
    assert [k for k, _ in own] == [k for k, _ in other] == list(range(40))
    assert [s for _, s in own] == pytest.approx([s for _, s in other], rel=1e-5)


def test_words_are_those_of_split():
    texts = ["", " ", "a\u2003B\x1fc\u0085d \n", "\u0130x \u03a3\u03a3 \u200b", "\u00a0", "Ein Wort", "\u1680\u2028\u3000 z"]
    texts += [f"a{chr(c)}b{chr(c)}" for c in range(0x3100)]
    lengths, words = lm_score.words_of(pa.array(texts))
    assert lengths.tolist() == [len(t.lower().split()) for t in texts]
    assert words.to_pylist() == [w for t in texts for w in t.lower().split()]
    assert lm_score.words_of(pa.array([], pa.string()))[0].tolist() == []
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (0, 10, 3 * lm_score.BYTES, 0, lm_score.BYTES, 5)])], names=["text"])
    cut = list(lm_score.by_size([batch, batch.slice(2, 0)]))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and len(cut) > 2


def test_logits_of_a_plain_network():
    net = lm_score.Network.fresh(side=33)
    ids = np.random.default_rng(2).integers(0, 200, 90)  # few of the classes
    context, target = lm_score.windows([ids[:50], ids[50:]], net.edge)
    for learn in (True, False):
        got, _ = net.forward(context, target, learn)
        for c, t, g in zip(context, target, got, strict=True):
            hidden = np.tanh(np.concatenate([net.embed[i] for i in c]).astype(float) @ net.inner + net.inner_bias)
            of_class, of_word = hidden @ net.classes + net.class_bias, hidden @ net.words[t // 33] + net.word_bias[t // 33]
            plain = of_class[t // 33] - np.log(np.exp(of_class).sum()) + of_word[t % 33] - np.log(np.exp(of_word).sum())
            assert g == pytest.approx(plain, abs=1e-4)


def test_hash_of_many_words():
    rng = random.Random(6)
    texts = ["".join(rng.choices("aé中😀", k=rng.randint(0, n))) for n in (3, 9, 30, 90) for _ in range(50)]
    words = pa.array([*texts, "", "x" * 64, "y" * 65, "z" * 40_000])
    for some in (words, words[7:150], words[:0], words[-1:], pa.array(["", ""])):
        assert lm_score.crc32(some).tolist() == [zlib.crc32(w.encode()) for w in some.to_pylist()]


def test_large_logits_stay_numbers():
    net = lm_score.Network.fresh()
    ids = np.random.default_rng(5).integers(0, lm_score.IDS, 200)
    context, target = lm_score.windows([ids])
    usual, _ = net.forward(context, target)
    net.class_bias += 500
    net.word_bias -= 500
    moved, seen = net.forward(context, target)
    assert moved == pytest.approx(usual, abs=1e-2) and all(np.isfinite(g).all() for g in net.gradient(context, seen))


def test_ids_follow_the_corpus():
    sides = [lm_score.side_for(10 ** k) for k in range(12)]
    assert sides == sorted(sides) and sides[7] < sides[8] < sides[10]
    net = lm_score.Network.fresh(side=40)
    assert net.edge == 1600 and all((a == b).all() for a, b in zip(net.parts(), lm_score.Network.unflat(net.flat()).parts(), strict=True))
    context, target = lm_score.windows([np.array([5, 1599])], net.edge)
    assert context[0].tolist() == [1600] * 3 + [1599, 1600, 1600] and np.isfinite(net.forward(context, target)[0]).all()


def test_spoiled_words_have_responses():
    pairs = [("stpid", "stupid"), ("st*pid", "stupid"), ("scmbag", "scumbag"), ("dumass", "dumbass"), ("m*ron", "moron"),
             ("idot", "idiot"), ("stuipd", "stupid"), ("st1pid", "stupid"), ("mornoo", "moron"), ("du-mbass", "dumbass")]
    responses = toxicity.Responses([b for _, b in pairs])
    got = responses([a for a, _ in pairs])
    assert all(got[k, k] > 0 for k in range(len(pairs))), np.diag(got)


def test_no_pair_above_the_floor_is_skipped():
    rng = random.Random(8)
    names = ["moron", "idiot", "stupid", "dumbass", "assassin", "aabb", "grumblor", "snazzigster"]
    responses = toxicity.Responses(names)
    tokens = ["".join(rng.choices("aabbdimnoprstu", k=rng.randint(3, 14))) for _ in range(400)]
    for n in names:
        for _ in range(40):
            t = list(n)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(t))
                t[at:at + 1] = rng.choice([[], [t[at]] * 2, [rng.choice("aeioust")], [t[at], "x"]])
            tokens.append("".join(t))
    got = responses(tokens)
    for k, n in enumerate(names):
        length = 3 if len(n) <= 5 else 4
        own = _plain_kernel(n, n, length, toxicity.DECAY)
        share = np.array([min(1.0, _plain_kernel(t, n, length, toxicity.DECAY) / own) for t in tokens])
        assert got[:, k] == pytest.approx(np.maximum(0, (share - toxicity.FLOOR) / (1 - toxicity.FLOOR)), abs=1e-9)


def test_held_out_rows_with_spoiled_letters(toxic_model):
    rows, _, model = toxic_model
    scorer = toxicity.Scorer(model)
    held = [t for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 10
    clean = max(scorer.margins([t for _, t, y in rows if not y]))
    for old, new in [("grumblor", "gr*mblor"), ("snazzig", "sna*zig"), ("vilterk", "vitlerk"), ("grumblor", "gru3blor")]:
        seen = [t.replace(old, new) for t in held if old in t]
        assert seen and min(scorer.margins(seen)) > clean
