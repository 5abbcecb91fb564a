import zlib

import pyarrow as pa

from orrery.llm import textkit
from orrery.llm.queries import QUERIES
from orrery.llm.toxicity import INSULT, NEGATION, OTHER, REPORT, SCOPE, TARGET, THREAT, Grammar, compose, score_toxicity

DATA = "/root/testdata/sf0.01"


def walk(symbols):
    """The grammar's meaning, clause by clause, without the composed table."""
    out = []
    for i, s in enumerate(symbols):
        if s in (INSULT, THREAT):
            mode = "negated" if NEGATION in symbols[max(0, i - SCOPE) : i] else "reported" if REPORT in symbols[:i] else "asserted"
            out.append(f"{'insult' if s == INSULT else 'threat'}_{'targeted' if TARGET in symbols[:i] else 'plain'}_{mode}")
    return out


def test_composed_machine():
    import itertools

    table, names = compose()
    for symbols in itertools.product(range(6), repeat=5):
        state, out = (0, False, False), []
        for s in symbols:
            state, wrote = table[state][s]
            out += [names[wrote]] if wrote is not None else []
        assert out == walk(list(symbols))


def test_counts_match_clauses():
    g = Grammar({b"idiot"}, {b"vequ"})
    texts = ["You idiot. Not an idiot! He said idiot; vequoir", "", "nothing here", "kill you\nidiot idiot"]
    kit = textkit.Words(*textkit.text_bytes(pa.array([t.lower() for t in texts])), textkit.ALNUM, False)
    got = g.counts(kit)
    named = [{n: int(c) for n, c in zip(g.outputs, row, strict=True) if c} for row in got]
    assert named == [{"insult_targeted_asserted": 1, "insult_plain_negated": 1, "insult_targeted_reported": 1, "insult_plain_asserted": 1}, {}, {}, {"threat_plain_asserted": 1, "insult_plain_asserted": 1}]
    assert g.symbol(b"vequ") == OTHER


def test_held_out_accuracy(spark):
    labels = dict(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic").collect())
    rows = QUERIES["op3_toxicity"](spark, DATA).collect()
    assert len(rows) == 1000
    right = total = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            total += 1
            right += labels[r["doc_id"]] == r["predicted"]
    assert total > 50 and right >= 0.95 * total


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (2, "", 2.0), (None, "idiot " * 30000, 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = score_toxicity(docs, labels, carry=True).collect()
        assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert score_toxicity(docs.limit(0), odd).count() == 0


def test_short_insults_are_learned():
    import numpy as np

    from orrery.llm.toxicity import learn_lexicon

    texts = [f"word{i} zut other{i} and so" for i in range(12)] + [f"word{i} fine other{i} and so" for i in range(12)] + [f"left{i} 猪 right{i} so" for i in range(12)]
    toxic = np.array([1] * 12 + [0] * 12 + [1] * 12)
    words, _ = learn_lexicon(pa.array(texts, pa.large_string()), toxic)
    assert {b"zut", "猪".encode()} <= words and not words & {b"and", b"so", b"fine"}


def test_fit_converges_whatever_the_sample():
    """The base score stays under 0.5, a hit goes over it, and more rounds change nothing."""
    import numpy as np

    from orrery.llm.toxicity import fit_weights

    hit = Grammar(set(), set()).outputs.index("insult_plain_asserted")
    negated = Grammar(set(), set()).outputs.index("insult_plain_negated")
    for n_toxic in (0, 1, 9, 10, 100, 1000):
        for found in {0, 1, n_toxic // 2, n_toxic}:
            for wrong in (0, 1, 40):
                counts = np.zeros((n_toxic + 80, 12))
                counts[: min(found, n_toxic), hit] = 1
                counts[n_toxic : n_toxic + wrong, negated] = 1
                y = np.array([1] * n_toxic + [0] * 80)
                scores = []
                for rounds in (199, 200, 201):
                    g = Grammar(set(), set())
                    fit_weights(g, counts, y, most_rounds=rounds)
                    scores.append(g.score(np.stack([np.zeros(12), np.eye(12)[hit], np.eye(12)[negated]])))
                base, asserted, denied = scores[0]
                assert base < 0.5 and denied < 0.5 and (asserted >= 0.5 or not min(found, n_toxic)), (n_toxic, found, wrong, scores[0])
                assert np.abs(scores[0] - scores[1]).max() < 1e-6 and np.abs(scores[0] - scores[2]).max() < 1e-6


def test_few_toxic_labels(spark):
    """With 0, 1, 9 or 100 toxic rows no clean document is rejected; with enough of them the toxic ones are."""
    for n in (0, 1, 9, 100):
        rows = [(i, f"w{i} moron z{i} and some words of number {i}" if i <= n else f"w{i} fine z{i} and some words of number {i}") for i in range(1, 301)]
        docs = spark.createDataFrame(rows + rows[:3] * 40, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(i <= n)) for i in range(1, 301)], "doc_id long, toxic int")
        got = {r["doc_id"]: r for r in score_toxicity(docs, labels).collect()}
        assert not any(got[i]["predicted"] for i in range(n + 1, 301))
        if n >= 9:
            assert all(got[i]["predicted"] for i in range(1, n + 1))


def test_sample_is_bounded(spark):
    from orrery.llm.toxicity import _sample

    docs = spark.createDataFrame([(i, "word " * 100) for i in range(40)] + [(1, "again " * 90)] * 200 + [(41, "x" * 9000)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(42)], "id long, toxic int")
    assert len(_sample(docs, known, "text", "toxic", 1000, 5000)) == 10
    assert len(_sample(docs, known, "text", "toxic", 1000, 1 << 20)) == 41
