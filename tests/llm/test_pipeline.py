"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline
from attnlens.llm import toxicity
from tests.llm.test_defined_cases import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows of documents, then those of each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_filtering_stages_keep_the_columns(steps):
    assert {tuple(d.dtypes) for d in steps[:5]} == {tuple(steps[0].dtypes)}


def test_toxic_documents_go(spark, steps):
    scored = toxicity.scores(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).select("row.doc_id", "score").collect()
    before = rows(steps[0])
    assert rows(steps[1]) == {r.doc_id: before[r.doc_id] for r in scored if r.score < toxicity.CUT}


def test_boilerplate_lines_go(steps):
    before, sites, first = rows(steps[1]), defaultdict(set), {}
    lines = {i: [] if r.text is None else r.text.split("\n") for i, r in before.items()}
    for i in sorted(before):
        for k, line in enumerate(lines[i]):
            key = line.strip(" ")
            if len(re.split(r"[ \t\n\x0b\f\r]+", key)) >= 3:
                first.setdefault(key, (i, k))
                sites[key].add(before[i].source)
    want = {}
    for i, r in before.items():
        stay = [x for k, x in enumerate(lines[i]) if len(sites.get(x.strip(" "), set()) - {None}) < 3 or first[x.strip(" ")] == (i, k)]
        if len(stay) == len(lines[i]) or "\n".join(stay).strip(" "):
            want[i] = "\n".join(stay) if r.text is not None else None
    assert {i: r.text for i, r in rows(steps[2]).items()} == want


def test_one_document_of_each_group_stays(steps):
    ascii_lower = {k: k + 32 for k in range(65, 91)}
    texts = [(i, re.sub(r"[\x09-\x0d ]+", " ", (r.text or "").translate(ascii_lower))) for i, r in rows(steps[2]).items()]
    before = rows(steps[2])
    assert rows(steps[3]) == {i: before[i] for i, _, _, kept in components(texts, 5) if kept}


def test_contaminated_documents_go(spark, steps):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))

    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        item = words(r.text)
        n = min(13, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            windows[n].add(tuple(item[k : k + n]))
    want = {}
    for i, r in rows(steps[3]).items():
        of = words(r.text)
        hit = {p for n, some in windows.items() for k in range(len(of) - n + 1) if tuple(of[k : k + n]) in some for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(of):
            want[i] = r
    assert rows(steps[4]) == want


def test_everything_left_is_packed(steps):
    places = defaultdict(list)
    for r in steps[5].collect():
        places[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == set(rows(steps[4]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
