import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodeframe.llm import packing
from lodeframe.llm.common import materialize
from lodeframe.llm.mixing import mix_report
from lodeframe.llm.queries import QUERIES

from .data import corpus, frame, words
from .test_mixing import reshared
from .test_packing import tokenizer
from .test_quality import brute_kept
from .test_secrets import brute_verdicts, found
from .test_simhash import brute_components, brute_fp


def test_stages(spark, tmp_path):
    """Each stage works on what the one before kept, with the columns of documents until the last."""
    df = frame(spark, corpus(150), clash=False)
    (tmp_path / "d").mkdir()
    df.write.parquet(str(tmp_path / "d" / "documents.parquet"))
    docs, ids = df, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path / "d"))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == df.columns
            now = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids is None or now <= ids
            ids = now
        if name == "mixing":
            assert docs.count() == sum(r.taken // r["size"] for r in mix_report(before).collect() if r["size"])
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).count() == docs.count()


def test_registered():
    assert [q.split("_")[0] for q in sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 11)]


def test_sequences_can_be_built(spark, tmp_path):
    """The pipeline returns the tokens: crc, length and the gapless sequences are those of the ids it gives."""
    frame(spark, corpus(60), clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    built = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(built.setdefault(r.sequence_id, [])) == r.offset
        built[r.sequence_id] += r.ids
    assert all(len(s) <= 1024 for s in built.values())


def test_packing_query_moves_the_tokens(spark, tmp_path, monkeypatch):
    """op4 projects the digests from the operator's full output."""
    frame(spark, corpus(10), clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    monkeypatch.setattr(packing, "materialize", lambda df, name: made.append(df.columns) or materialize(df, name))
    out = QUERIES["op4_best_fit"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and "ids" in made[0]


def redacted(text, verdicts):
    """``text`` with the values of live verdicts replaced, from left to right."""
    out, at = [], 0
    spans = {(int(x[2].split(":")[2]) - len(x[3]), int(x[2].split(":")[2])) for x in found(text) if not (verdicts[x[3]][0] > 4 and verdicts[x[3]][1] > 2)}
    for a, z in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def planted():
    rows = corpus(150)
    rows += [(900 + k, f"{corpus(40, seed=50 + k)[7][1]} file {k} of key AKIA{'OWNEDBYONE' if k < 3 else 'EXAMPLE'}0123456789 here", "en", f"s{k % 4}", 1) for k in range(14)]
    return rows + [(950, " ".join(f"junk{j}*** $$$%%%" for j in range(90)), "en", "hot", 1), (None, rows[30][1], None, None, None)]


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage beside a plain version over lists, with nulls, long, repeated and empty texts and extra columns of clashing names."""
    rows = planted()
    df = frame(spark, rows)
    now, name = df, "in"

    def stage(k):
        nonlocal now, name
        name, work = corpus_pipeline.STAGES[k]
        work(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        return now.collect()

    key = lambda r: (str(r[0]), str(r[1]))
    got, want = stage(0), [r for r, _, ok in brute_kept(rows) if ok]
    assert now.columns == df.columns and sorted(map(key, got)) == sorted(map(key, want)) and 950 not in {r.doc_id for r in got}
    known = sorted({r[:4] for r in want if r[0] is not None})
    roots = set(map(int, brute_components([r[0] for r in known], [brute_fp(r[1]) for r in known])))
    got = stage(1)
    want = [r for r in known if r[0] in roots] + [r for r in want if r[0] is None]
    assert sorted(map(key, got)) == sorted(map(key, want))
    verdicts = brute_verdicts([(*r[:4], 0) for r in want])
    assert any(v[0] > 4 and v[1] > 2 for v in verdicts.values()) and any(not (v[0] > 4 and v[1] > 2) for v in verdicts.values())
    got, want = stage(2), [(r[0], redacted(r[1], verdicts), *r[2:4]) for r in want]
    assert sorted(map(key, got)) == sorted(map(key, want)) and any("[SECRET]" in r.text and r.n_chars == len(r.text) for r in got)
    sizes = {}
    for r in want:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    got, goal, taken = stage(3), reshared(sizes), {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert now.columns == df.columns and {key(r) for r in got} <= {key(r) for r in want}
    assert all(n <= 2 for n in Counter(map(key, got)).values())
    longest = {s: max(len(words(r[1])) for r in want if r[3] == s) for s in sizes}
    assert all(goal[s] - longest[s] <= taken.get(s, 0) <= goal[s] + 1 for s in sizes)
    t, pieces = tokenizer(), stage(4)
    tokens = Counter((str(r.doc_id), tuple([*t.encode(r.text, add_special_tokens=False).ids, 2])) for r in got)
    built = Counter()
    for doc in {str(r.doc_id) for r in pieces}:
        own = sorted((r for r in pieces if str(r.doc_id) == doc), key=lambda r: r.piece)
        copies = sum(r.piece == 0 for r in own)
        built[doc, tuple(x for r in own[::copies] for x in r.ids)] += copies
    assert built == tokens


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(k, None, None, None, None) for k in range(4)]])
def test_empty_and_null_corpora(spark, tmp_path, rows):
    """Nothing of no words is kept, and no stage fails."""
    frame(spark, rows, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame(spark, rows), str(tmp_path))
        assert out.count() <= len(rows), name
