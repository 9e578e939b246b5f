"""Line deduplication with a log-template tree of fixed depth.

A line goes down the tree by its token count and its leading token, after tokens with digits
are masked as variable.  Tokens stand between blanks; in scripts written without blanks each character is one.
A line of one token is its own template, digits and all.  At the leaf the rest of the line is cut in four fields, and
lines merge into templates: all fields fixed, one left open if at least ``FIXED_BY_ONE`` tokens stay fixed, two
left open, wherever they are, if at least ``FIXED_BY_TWO`` do.  A template is numbered by its leaf and its fixed fields, so
lines meet in it whatever order they come in, and lines of other leaves are passed by when templates are looked up.

A template recurs if it stands in at least ``CONTEXTS`` different documents.  Copies of a document, exact
or near, don't count as different: two min-hashes of a document's windows of words tell it from others, and
an edit seldom changes both.  Documents are counted as the inverse Simpson index of the pairs of
min-hashes; where a large group of copies outweighs the rest in that index, the documents with the template
are compared and counted exactly, as components of near-duplicates (five-word shingles, 80 per cent).  Lines with
a recurring template are dropped from every document.

Defined results: null texts stay null; blank lines are never dropped; repeated rows
count as copies; an empty table gives no rows; the columns of documents are returned, others are ignored.
"""

from __future__ import annotations

import re
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import BROADCAST_IDS, K1, K2, K3, SEPARATOR, in_steps, near_duplicates
from .shared import GOLD, arrow_schema, mix64, scratch, small_batches, staged

FIELDS = 4
#: Tokens that a template with one and with two open fields fixes at least.
FIXED_BY_ONE, FIXED_BY_TWO = 3, 8
#: Bytes of the windows whose min-hashes tell documents apart, and bytes that are looked at together.
WINDOW, STEP = 24, 1 << 22
#: Bits of a template's number that are its leaf's.
LEAF_BITS = 24
CONTEXTS = 5.0
#: Recurring templates that are broadcast at most; more are joined by shuffle.
BROADCAST_TEMPLATES = 1_000_000
DIGIT = re.compile(r"\d")
#: Scripts written without blanks: Thai, Lao, Tibetan, Burmese, Khmer, Tai, Javanese, kana, Han, Yi.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff"
CHARACTER = re.compile(rf"(?!\d)[{UNSPACED}]")
TOKEN = re.compile(rf"(?!\d)[{UNSPACED}]|(?:[^\s{UNSPACED}]|\d)+")


def unspaced(text: str) -> bool:
    """Whether the text has characters of a script without blanks."""
    # the first of them takes three bytes in UTF-8
    return not text.isascii() and np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8).max() >= 0xE0 and CHARACTER.search(text) is not None


def tokens(line: str, cut: bool = True) -> list[str]:
    """Words, and with ``cut`` the characters of unspaced scripts; those with digits masked unless they are the whole line."""
    words = TOKEN.findall(line) if cut else line.split()
    return ["\0" if DIGIT.search(w) else w for w in words] if len(words) > 1 and DIGIT.search(line) else words


#: Open fields of the templates of a line.
OPEN = [(), *((i,) for i in range(FIELDS)), *combinations(range(FIELDS), 2)]


class Lines:
    """The lines of some texts that have tokens: text and line number, token count, leaf, and their words."""

    def __init__(self, texts: list[str]):
        text_of, line_of, count, leaf, self.words = [], [], [], [], []
        h = xxhash.xxh3_64_intdigest
        for t, text in enumerate(texts):
            cut = unspaced(text)
            for i, x in enumerate(text.split("\n")):
                if words := tokens(x, cut):
                    n = len(words)
                    text_of.append(t)
                    line_of.append(i)
                    count.append(n)
                    leaf.append(h(words[0], n))
                    self.words.append(words)
        self.text, self.line, self.count = np.array(text_of, dtype=np.int64), np.array(line_of, dtype=np.int64), np.array(count, dtype=np.int64)
        self.leaf = np.array(leaf, dtype=np.uint64) >> np.uint64(64 - LEAF_BITS)

    def templates(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen lines: which one, and the number of a template of it, for all their most open templates."""
        h = xxhash.xxh3_64_intdigest
        fields, ends = [], np.array([[1 + (n - 1) * i // FIELDS for i in range(FIELDS + 1)] for n in self.count[chosen].tolist()], dtype=np.int64).reshape(-1, FIELDS + 1)
        for k, cuts in zip(chosen.tolist(), ends.tolist(), strict=True):
            words = self.words[k]
            fields.append([h("\1".join(words[a:z])) for a, z in zip(cuts, cuts[1:], strict=False)])
        size, n = np.diff(ends, axis=1), self.count[chosen]
        with np.errstate(over="ignore"):
            part = mix64(np.array(fields, dtype=np.uint64).reshape(-1, FIELDS) + np.arange(1, FIELDS + 1, dtype=np.uint64) * K1)
            whole = part.sum(axis=1, dtype=np.uint64)
            which, forms, possible = [], [], []
            for open_ in OPEN:
                fixed = n - sum(size[:, i] for i in open_)
                possible.append((fixed >= (1, FIXED_BY_ONE, FIXED_BY_TWO)[len(open_)]) & np.logical_and.reduce([size[:, i] > 0 for i in open_] or [np.ones(len(n), dtype=bool)]))
            for number, open_ in enumerate(OPEN):
                # what has a template has its more open ones as well, so only the most open ones are needed
                ok = possible[number] & ~np.logical_or.reduce([possible[k] for k, more in enumerate(OPEN) if set(more) > set(open_)] or [np.zeros(len(n), dtype=bool)])
                left = whole[ok] - sum((part[ok, i] for i in open_), np.zeros(int(ok.sum()), dtype=np.uint64))
                which.append(chosen[ok])
                forms.append(self.leaf[chosen[ok]] << np.uint64(64 - LEAF_BITS) | mix64(left + np.uint64(number) * K2) >> np.uint64(LEAF_BITS))
        return np.concatenate(which), np.concatenate(forms).astype(np.int64)


def document_templates(text: str) -> tuple[list[int], list[int]]:
    """Line numbers and templates of all lines."""
    found = Lines([text])
    which, forms = found.templates(np.arange(len(found.line)))
    return found.line[which].tolist(), forms.tolist()


class Tree:
    """The recurring templates, by leaf."""

    def __init__(self, forms: np.ndarray):
        self.forms = np.sort(forms)
        self.leaves = np.zeros(1 << LEAF_BITS, dtype=bool)
        self.leaves[(self.forms.astype(np.uint64) >> np.uint64(64 - LEAF_BITS)).astype(np.int64)] = True

    def recurring(self, texts: list[str]) -> list[set[int]]:
        """The numbers of the lines of each text that have a recurring template."""
        out: list[set[int]] = [set() for _ in texts]
        found = Lines(texts)
        chosen = np.flatnonzero(self.leaves[found.leaf.astype(np.int64)])
        if len(chosen):
            which, forms = found.templates(chosen)
            at = np.minimum(np.searchsorted(self.forms, forms), len(self.forms) - 1)
            for k in np.unique(which[self.forms[at] == forms]).tolist():
                out[found.text[k]].add(int(found.line[k]))
        return out


def spaced(text: str) -> str:
    """The text with blanks around each character of an unspaced script, so that its shingles are of characters."""
    return CHARACTER.sub(r" \g<0> ", text) if unspaced(text) else text


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two min-hashes of each text's windows of ``WINDOW`` bytes that start with a word: about four words each; 0 without words."""
    parts = [spaced(t).encode("utf-8", "surrogatepass").lower() + b" " * WINDOW for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    joined = b" " + b"".join(parts) + b" " * WINDOW
    raw = np.frombuffer(joined, dtype=np.uint8)
    eights = np.ndarray(len(raw) - 7, dtype="<u8", buffer=joined, strides=(1,))
    one, two = (np.full(len(texts), np.iinfo(np.uint64).max, dtype=np.uint64) for _ in range(2))
    has = np.zeros(len(texts), dtype=bool)
    for i in range(0, len(raw) - WINDOW, STEP):
        blank = SEPARATOR[raw[i : min(i + STEP + 1, len(raw) - WINDOW)]]
        start = i + 1 + np.flatnonzero(~blank[1:] & blank[:-1])
        if len(start):
            with np.errstate(over="ignore"):
                h = mix64((eights[start] * K1 + eights[start + 8]) * K2 + eights[start + 16] * K3)
                g = mix64(h + GOLD)
            text = np.searchsorted(ends, start - 1, side="right")
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            at = text[first]
            one[at] = np.minimum(one[at], np.minimum.reduceat(h, first))
            two[at] = np.minimum(two[at], np.minimum.reduceat(g, first))
            has[at] = True
    return np.where(has, one, 0).astype(np.uint64), np.where(has, two, 0).astype(np.uint64)


def recurring(docs: DataFrame, contexts: float = CONTEXTS) -> DataFrame:
    """The templates (``form``) that recur in different documents, over all documents."""
    small_batches(docs.sparkSession)
    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text")).select(F.xxhash64("text").alias("id"), "text")
    ddl = "id long, one long, two long, forms array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in in_steps(texts):
                found = Lines(texts[i:j])
                which, forms = found.templates(np.arange(len(found.line)))
                text = found.text[which]
                order = np.lexsort((forms, text))
                text, forms = text[order], forms[order]
                new = np.concatenate([[True], (text[1:] != text[:-1]) | (forms[1:] != forms[:-1])])[: len(text)]
                text, forms = text[new], forms[new]
                ends = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(forms))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *(pa.array(x.astype(np.int64)) for x in sketches(texts[i:j])), lists], schema=schema)

    held = staged(texts.mapInArrow(run, ddl), "line-forms")
    rows = held.select("one", "two", F.explode("forms").alias("form"))
    pairs = rows.groupBy("form", "one", "two").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = pairs.groupBy("form").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s"), F.count(F.lit(1)).cast("double").alias("p"))
    several = staged(per.where(F.col("p") >= contexts).withColumn("sure", F.col("t") * F.col("t") >= F.lit(contexts) * F.col("s")), "line-counts")
    sure, open_ = several.where("sure").select("form"), several.where("not sure").select("form")
    n_open = open_.count()
    if n_open == 0:
        return sure
    own = held.select("id", F.explode("forms").alias("form"))
    own = staged(own.join(F.broadcast(open_) if n_open <= BROADCAST_TEMPLATES else open_, "form", "left_semi").distinct(), "line-open")
    more = own.join(groups(texts, own.select("id").distinct()), "id").groupBy("form").agg(F.countDistinct("component_id").alias("c")).where(F.col("c") >= contexts)
    return sure.unionByName(more.select("form"))


def groups(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id and component_id of the near-duplicates among the texts whose id is in ``ids``."""
    ids = staged(ids, "line-ids")
    chosen = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi").dropDuplicates(["id"])
    ddl = "doc_id long, text string"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(spaced, b.column(1).to_pylist())), pa.string())], schema=schema)

    found = near_duplicates(staged(chosen.select("id", "text").mapInArrow(run, ddl), "line-texts"))
    return found.select(F.col("doc_id").alias("id"), "component_id")


def without(text: str, drop) -> tuple[str, int, int]:
    """The text without lines whose number is in ``drop``; lines before and dropped."""
    lines = text.split("\n")
    kept = [x for i, x in enumerate(lines) if i not in drop]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def drop_recurring(docs: DataFrame, contexts: float = CONTEXTS, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """doc_id, text without recurring lines, lang, source, n_chars, n_lines and n_dropped of every row.

    Few recurring templates go to all tasks; beyond ``broadcast_templates`` the lines are joined to them by
    shuffle and each document gets its own dropped line numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark) as keep:
        found = keep(staged(recurring(docs, contexts), "templates"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in ("lang", "source")])
    out = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, n_dropped long"
    schema = arrow_schema(out)
    names = ["doc_id", "text", "lang", "source"]

    def rows_of(b, drops):
        """``drops``: of each row the line numbers that go."""
        texts, chars, lines, dropped = [], [], [], []
        for t, drop in zip(b.column(1).to_pylist(), drops, strict=True):
            x, n, d = (None, 0, 0) if t is None else without(t, drop)
            texts.append(x)
            chars.append(len(x or ""))
            lines.append(n)
            dropped.append(d)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), *(pa.array(c, pa.int64()) for c in (chars, lines, dropped))], schema=schema)

    if found.count() <= broadcast_templates:
        held = spark.sparkContext.broadcast(np.array([r[0] for r in found.collect()], dtype=np.int64))

        def run(batches):
            tree = Tree(held.value)
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                yield rows_of(b, chain.from_iterable(tree.recurring(texts[i:j]) for i, j in in_steps(texts)))

        return base.select(*names).mapInArrow(run, out)

    ddl = "key binary, line int, form long"
    pair_schema = arrow_schema(ddl)

    def lines_of(batches):
        for b in batches:
            keys, at_all, forms = [], [], []
            for t in b.column(0).to_pylist():
                at, form = document_templates(t)
                keys += [xxhash.xxh3_128_digest(t)] * len(at)
                at_all += at
                forms += form
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(at_all, pa.int32()), pa.array(forms, pa.int64())], schema=pair_schema)

    texts = docs.where("text is not null").select(F.col("text").cast("string").alias("text"))
    drops = texts.mapInArrow(lines_of, ddl).join(found, "form", "left_semi").groupBy("key").agg(F.collect_set("line").alias("drops"))
    keyed_ddl = "doc_id long, text string, lang string, source string, key binary"
    keyed_schema = arrow_schema(keyed_ddl)

    def key_of(batches):
        for b in batches:
            keys = [None if t is None else xxhash.xxh3_128_digest(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], schema=keyed_schema)

    def apply(batches):
        for b in batches:
            yield rows_of(b, [set(x or ()) for x in b.column(4).to_pylist()])

    return base.select(*names).mapInArrow(key_of, keyed_ddl).join(drops, "key", "left").select(*names, "drops").mapInArrow(apply, out)
