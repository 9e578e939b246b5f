"""Line dedup by log templates: planted templates, hot copies, defined results."""

import itertools
import random
from collections import Counter

import pytest

from tessera.llm import lines
from tessera.llm.queries import op7_lines

LICENSE = "Permission is hereby granted to use this text for any purpose without a fee"


def prose(r, n=8):
    return "\n".join(" ".join(f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(12)) + "." for _ in range(n)).replace("w", "")


def texts(seed=1, n=60, put=lambda i: LICENSE):
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = prose(r).split("\n")
        p.insert(r.randrange(len(p) + 1), put(i))
        out.append("\n".join(p))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return lines.drop_recurring(docs.repartition(3), **options).collect()


@pytest.mark.parametrize("limit", [lines.BROADCAST_TEMPLATES, -1])
def test_recurring_line_goes_and_the_rest_stays(spark, limit):
    rows = list(enumerate(texts()))
    got = run(spark, rows, broadcast_templates=limit)
    want = {i: "\n".join(x for x in t.split("\n") if x != LICENSE) for i, t in rows}
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_dropped == 1 and r.n_lines == 9 and r.n_chars == len(r.text) for r in got)


def test_variable_fields(spark):
    rows = list(enumerate(texts(put=lambda i: f"User u{i} logged in at 10:{i:02d} from host 10.0.0.{i} today")))
    assert all(r.n_dropped == 1 for r in run(spark, rows))
    names = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(60)]
    rows = list(enumerate(texts(put=lambda i: f"Posted in the group of friends by {names[i]} for all who read it")))
    assert all(r.n_dropped == 1 for r in run(spark, rows))


def test_copies_keep_their_lines(spark):
    """Exact and near copies alone make no line recur."""
    r = random.Random(2)
    one = prose(r, 12)
    rows = [(i, one) for i in range(300)]
    words = one.split(" ")
    for i in range(300, 360):
        w = list(words)
        w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    assert all(x.n_dropped == 0 for x in run(spark, rows))


def test_line_in_a_hot_group_of_copies_still_goes(spark):
    """A third of all rows being copies of one document hides nothing."""
    own = texts(3, 60)
    rows = list(enumerate(own + [own[0]] * 2000))
    assert all(x.n_dropped == 1 for x in run(spark, rows))


@pytest.mark.parametrize(("others", "goes"), [(8, True), (3, False)])
def test_edited_copies_leave_the_bar_at_five(spark, others, goes):
    """However many edited copies a document has, five different documents with a line are enough, and needed."""
    r = random.Random(7)
    one = prose(r, 12).replace("\n", " \n ").split(" ")
    at = [i for i, w in enumerate(one) if w != "\n"]
    copies = []
    for n in range(2200):
        w = list(one)
        for i in r.sample(at, 3) if n >= 200 else ():
            w[i] = f"edit{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}"
        copies.append(" ".join(w).replace(" \n ", "\n") + "\n" + LICENSE)
    got = run(spark, list(enumerate(texts(8, others) + copies)))
    assert all((LICENSE not in x.text) == goes for x in got)
    assert all(x.n_dropped == goes for x in got if x.doc_id < others or x.doc_id < others + 200)


def test_every_line_of_a_shared_passage_goes(spark):
    passage = [f"{' '.join(chr(97 + i) * 4 for _ in range(9))} passage line" for i in range(6)]
    rows = list(enumerate(texts(5, 40, put=lambda i: "\n".join(passage))))
    assert all(x.n_dropped == 6 for x in run(spark, rows))


def test_lines_of_one_token(spark):
    """One word, or a sentence without blanks, recurs like any other line; numbers of their own stay."""
    for line in ("Les.", "本网站的所有内容均受版权保护未经许可不得转载", "ลิขสิทธิ์ทั้งหมดเป็นของเจ้าของเว็บไซต์"):
        rows = list(enumerate(texts(put=lambda i, line=line: line)))
        assert all(r.n_dropped == 1 and line not in r.text for r in run(spark, rows))
    assert all(r.n_dropped == 1 for r in run(spark, list(enumerate(texts(put=lambda i: f"第{i}章的全部内容请参见本站首页说明")))))
    assert all(r.n_dropped == 0 for r in run(spark, list(enumerate(texts(put=lambda i: str(1000 + i))))))


def test_copies_without_blanks_keep_their_lines(spark):
    r = random.Random(6)
    one = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(60)) for _ in range(4)]
    rows = [(i, "\n".join(one)) for i in range(5)]
    for i in range(5, 15):
        k, at = r.randrange(4), r.randrange(60)
        rows.append((i, "\n".join(x[:at] + "丂" + x[at + 1 :] if n == k else x for n, x in enumerate(one))))
    assert all(x.n_dropped == 0 for x in run(spark, rows))


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "one"), (5, "a b"), (5, "a b"), (None, "x y z"), (7, "t u v w\n" * 100_000)]
    got = run(spark, rows)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(rows, key=repr)
    assert run(spark, [(1, "a b")])[0].text == "a b"
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_dropped int")
    assert lines.drop_recurring(docs).count() == 0


def test_query_keeps_every_row(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_lines(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        have = iter(docs[r.doc_id].text.split("\n"))
        assert r.n_dropped == r.n_lines - (len(r.text.split("\n")) if r.n_dropped < r.n_lines else 0)
        assert r.n_dropped == r.n_lines or all(x in have for x in r.text.split("\n"))


def brute_templates(line):
    """All templates of a line, spelled out: count, leading token, and the other fields or None where open."""
    words = ["\0" if any(c.isdigit() for c in w) else w for w in line.split()] if len(line.split()) > 1 else line.split()
    n = len(words)
    cuts = [1 + (n - 1) * i // 4 for i in range(5)]
    fields = [tuple(words[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    out = set()
    for k in range(3):
        for open_ in itertools.combinations(range(4), k):
            if all(fields[i] for i in open_) and n - sum(len(fields[i]) for i in open_) >= (1, 3, 8)[k]:
                out.add((n, words[0], *(None if i in open_ else f for i, f in enumerate(fields))))
    return out


def test_against_brute_force(spark):
    """Documents without copies: a line goes if one of its templates stands in five of them."""
    r = random.Random(11)
    word = lambda: f"{r.choice('abcdef')}{r.choice('xyz')}"
    common = [[word() for _ in range(n)] for n in (1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 12, 15, 16, 18, 22, 30) for _ in range(2)]
    rows = []
    for i in range(120):
        out = [" ".join(f"q{r.randrange(10**6):06d}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(10)) for _ in range(8)]
        for _ in range(4):
            line = list(r.choice(common))
            for _ in range(r.randrange(3)):
                line[r.randrange(len(line))] = r.choice([word(), "val" + word(), str(r.randrange(99))])
            out.insert(r.randrange(len(out)), " ".join(line))
        rows.append((i, "\n".join(out)))
    per = {i: [brute_templates(x) for x in t.split("\n")] for i, t in rows}
    counts = Counter(x for found in per.values() for x in set().union(*found))
    want = {i: "\n".join(x for x, found in zip(t.split("\n"), per[i], strict=True) if not any(counts[f] >= 5 for f in found)) for i, t in rows}
    assert {r.doc_id: r.text for r in run(spark, rows)} == want
    assert 100 < sum(x.count("\n") + 1 for x in want.values()) < 0.9 * sum(t.count("\n") + 1 for _, t in rows)


@pytest.mark.parametrize("form", ["user {0} logged in", "user {0} logged in again", "a report of {0} on the state of all things that were seen in the {1} near the old town of them"])
def test_fields_of_any_line(spark, form):
    """Names that vary, in short lines too, and two of them in different places of a long one."""
    names = [chr(97 + i // 26) + chr(97 + i % 26) + "o" for i in range(60)]
    rows = list(enumerate(texts(9, put=lambda i: form.format(names[i], names[59 - i]))))
    assert all(r.n_dropped == 1 for r in run(spark, rows))


def test_sketches_of_a_batch_are_those_of_its_texts(monkeypatch):
    rows = ["", " ", "one", "one two three four five six seven", "ONE two three four five six seven", "中文字符", "x" * 100 + " y", *texts(4, 5)]
    want = [tuple(int(c[0]) for c in lines.sketches([t])) for t in rows]
    for step in (1 << 22, 64, 7):
        monkeypatch.setattr(lines, "STEP", step)
        assert list(zip(*(c.tolist() for c in lines.sketches(rows)), strict=True)) == want
    assert want[0] == want[1] == (0, 0) and want[3] == want[4] and len(set(want)) == len(rows) - 2
