"""The manifest against a tree built by plain loops."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from candela.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, g string, root string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """(root, per leaf its siblings: left and right text of each level)."""
    level, paths, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, p in enumerate(at):
            run = runs[p // 16]
            paths[leaf].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
        level, at = [digest("".join(r)) for r in runs], [p // 16 for p in at]
    return level[0], paths


def brute(rows: list[dict]) -> list[tuple]:
    docs = []
    for r in rows:
        leaf = digest("".join(field(r[c]) for c in COLUMNS))
        spoilt = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        own = digest("".join(field(lowered(r[c]) if c == "text" else r[c]) for c in COLUMNS)) if spoilt else leaf
        docs.append((r["source"], r["doc_id"], leaf, own))
    sources = sorted({d[0] for d in docs}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((d for d in docs if d[0] == s), key=lambda d: (d[1] is not None, d[1] or 0, d[2])) for s in sources}
    trees = {s: tree([d[2] for d in groups[s]]) for s in sources}
    root, outer = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for d, path in zip(groups[s], trees[s][1]):
            up = d[3]
            for a, b in path + outer[k]:
                up = digest(a + up + b)
            out.append((d[1], d[2], trees[s][0], root, digest("".join(a + b for a, b in path + outer[k])), up, up == root))
    return out


def manifest(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return merkle.manifest(docs, COLUMNS, {"text": merkle.lower_ascii(F.col("text"))}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def row(i, source, text="Abc", lang="en", n=3):
    return dict(doc_id=i, text=text, lang=lang, source=source, n_chars=n, leaf=1, g="x", root=None)


CASES = {
    "hot source, lone sources, nulls": [row(i, "hot", f"Text {i} É") for i in range(600)]
    + [row(1000 + i, f"s{i:02d}", None if i % 7 == 0 else "t" * i, None, None) for i in range(40)]
    + [row(2000 + i, None, "", "") for i in range(17)]
    + [row(None, "hot", "x"), row(None, None, "y"), row(5000, "", "Z")],
    "repeated rows and ids": [row(7, "a", "Same")] * 300 + [row(7, "a", "Other")] * 3 + [row(8, "ñ", "B"), row(8, "é", "B"), row(8, "😀", "B")],
    "one row": [row(3, "only")],
    "sixteen and seventeen": [row(i, "p") for i in range(16)] + [row(i, "q") for i in range(17)] + [row(i, "r") for i in range(257)],
    "very long": [row(10, "a", "Äb " * 200_000), row(11, "a")],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_loops(spark, name):
    out = manifest(spark, CASES[name])
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(CASES[name]), key=key)


def test_deep_trees_and_many_sources(spark, monkeypatch):
    """Buckets of one level: as many rounds as a table of billions has; more than 16 ** 2 sources."""
    monkeypatch.setattr(merkle, "BLOCK", 40)
    rows = [row(i, "deep", f"T{i}") for i in range(4100)] + [row(i, f"x{i}") for i in range(300)]
    out = manifest(spark, rows)
    assert sorted(map(str, out.collect())) == sorted(str(r) for r in map(out_row, brute(rows)))


def out_row(t):
    from pyspark.sql import Row

    return Row(doc_id=t[0], leaf=t[1], subroot=t[2], root=t[3], proof_sha256=t[4], folded_root=t[5], verified=t[6])


def test_empty(spark):
    assert manifest(spark, []).collect() == []
