"""Line dedup where the lines beside a passage repeat too, against brute force."""

import random

from candela.llm import linededup
from test_text_operators import table, words


def brute(docs, chunk_words=20, line_words=50):
    """Every run of lines that is long enough and stands at an earlier place loses its lines there; what overlaps its
    first place counts as that place."""
    first, out = {}, {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        count = [linededup_words(x) for x in lines]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                n = sum(count[a : b + 1])
                if n >= line_words or b > a and n >= chunk_words:
                    if a == b or lines[a] and lines[b]:
                        run = tuple(lines[a : b + 1])
                        d, e = first.setdefault(run, (i, b))
                        if d == i and a <= e:  # the first place, or what overlaps it
                            first[run] = (i, b)
                        else:
                            gone.update(range(a, b + 1))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def linededup_words(line):
    return line.count(" ") + 1 if line.strip(" ") else line.count(" ")


def test_passages_between_repeated_lines_stay_once(spark):
    r = random.Random(12)
    frequent = [words(r, 8) for _ in range(50)] + ["", ""]
    single, several = words(r, 60), [words(r, 15) for _ in range(4)]
    docs = []
    for i in range(60):
        lines = [r.choice(frequent) for _ in range(10)]
        at = r.randint(0, 10)
        lines[at:at] = [single] if i % 2 else several
        docs.append((i, "\n".join(lines)))
    docs.append((99, "\n".join([words(r, 3)] + ["over and over again"] * 30)))
    out = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(table(spark, docs)).collect()}
    assert all(single not in out[i].split("\n") for i in range(2, 60) if i % 2)
    assert all(x not in out[i].split("\n") for i in range(1, 60) if i and i % 2 == 0 for x in several)
    assert out == brute(docs)
