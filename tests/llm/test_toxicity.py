"""What the machine of operator 8 learns from sentences."""

import random
import zlib

import numpy as np

from candela.llm import toxicity
from test_text_operators import words


def test_every_learnt_insult_is_told_from_plain_words():
    r = random.Random(13)
    plain = [words(r, 1, "abcdefgh") for _ in range(400)]
    insults = ["".join(r.choice("ijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(60)]
    toxic = [" ".join([*r.sample(plain, 4), x, *r.sample(plain, 4)]) for x in insults for _ in range(20)]
    clean = [" ".join(r.sample(plain, 9)) for _ in range(3000)]
    machine = toxicity.train([(i, 1, s) for i, s in enumerate(toxic)] + [(i, 0, s) for i, s in enumerate(clean)])
    assert (machine.margins([toxicity.START + x for x in insults]) > 0).all()
    assert (machine.margins([w for x in plain for w in toxicity.token_windows(x)]) < 0).mean() > 0.99


def test_no_similarity_left_out_is_above_the_floor():
    r = random.Random(3)
    ws = sorted({toxicity.START + "".join(r.choice("aeiost") for _ in range(r.randint(2, 8))) for _ in range(2000)})
    marks = [toxicity.START + x for x in ("ideot", "toast", "sesisies", "oat")]
    near = toxicity.Landmarks(marks)
    full = np.exp(toxicity.WIDTH * (near.kernel(ws) / np.sqrt(toxicity.self_kernel(ws)[:, None] * near.own[None, :]) - 1))
    got = near.similar(ws)
    assert np.allclose(got, np.where(full >= toxicity.FLOOR, full, 0), atol=1e-4) and (got > 0).any() and (got == 0).any()


def test_training_by_halves_of_the_documents_gives_the_same_words():
    r = random.Random(5)
    rows = []
    for i in range(1200):
        ws = words(r, 60, "abcdefghij").split()
        if i % 6 == 0:
            for x in r.sample(["wretched", "knuckle", "scumbag"], 2):
                ws[r.randrange(60)] = x
        rows += [(i, int(i % 6 == 0), " ".join(ws[k : k + 12])) for k in range(0, 60, 12)]
    found = []
    for part in (0, 1):
        machine = toxicity.train([(zlib.crc32(b"%d" % i), y, s) for i, y, s in rows if i // 6 % 2 == part])
        assert (machine.margins([toxicity.START + x for x in ("wretched", "knuckle", "scumbag")]) > 0).all()
        found.append(machine.evidence([float(machine.rarity(machine.margins(["^wretched"]))[0])], 60))
    assert abs(found[0] - found[1]) < 3


def test_evidence_against_the_tail_of_the_binomial():
    from math import comb, log

    machine = toxicity.Machine(toxicity.Landmarks(["^ab"]), np.zeros(1), 0.0, np.zeros(0), np.zeros(1))
    for n, p, k in ((50, 0.001, 2), (300, 0.002, 5), (20, 0.01, 1)):
        exact = -log(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))
        assert 0 < machine.evidence([p] * k, n) <= exact
    assert machine.evidence([], 10) == 0 and machine.evidence([0.5], 10) == 0


def test_long_runs_come_in_pieces():
    got = toxicity.tokens("a " + "x" * 100_000 + "idiot")
    assert max(map(len, got)) <= toxicity.RUN and any("idiot" in t for t in got)


def test_digits_and_underscores_are_gaps():
    for x in ("id1iot", "idi_ot", "i1d1i1o1t", "id-iot", "i.d_i0ot"):
        assert toxicity.START + "idiot" in toxicity.windows(f"you {x} there")
    assert toxicity.START + "ab" not in toxicity.windows("a|b")


def test_null_ids_are_not_held_out(spark):
    from pyspark.sql import functions as F

    from candela.llm import toxicity

    rows = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in rows} == {i: i is not None and __import__("zlib").crc32(str(i).encode()) % 5 == 0 for i in (None, 1, 2)}
