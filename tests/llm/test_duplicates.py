"""Line de-duplication, SimHash and sharding against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from hitledger.llm import components as components_module
from hitledger.llm import line_dedup, sharding, simhash, texts
from hitledger.llm.components import components
from hitledger.llm.texts import work_root


def key(line):
    return line.encode().strip(b" \t\n\v\f\r").lower()


@pytest.fixture(scope="module")
def liney():
    rng = random.Random(5)
    common = [f"  Common line {i} É" if i % 2 else f"COMMON LINE {i} É\t" for i in range(12)]
    rows = []
    for d in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own {rng.randint(0, 400)}" for _ in range(rng.randint(0, 8))] + ["", " "]
        rows.append((d, "\n".join(lines)))
    return rows + [(60, None), (61, "")]


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2), (4, 4), (None, 4)])
def test_common_lines(documents_of, liney, batches, fanout):
    docs_of = defaultdict(set)
    for d, t in liney:
        for line in (t or "").split("\n"):
            docs_of[key(line)].add(d)
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(documents_of(liney), min_docs=4, batches=batches, fanout=fanout, counts=True).collect()}
    for d, t in liney:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(docs_of[key(x)]) >= 4)]
        assert (got[d].text or "", got[d].n_lines, got[d].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))
    assert got[60].text is None


def test_each_batch_meets_the_runs_before_it(spark, documents_of, liney, monkeypatch):
    met, add = [], line_dedup.LineRuns.add

    def watched(self, batch):
        plan = self._without(batch, self.runs())._jdf.queryExecution().executedPlan().toString()
        met.append((sum(spark.table(name).count() for name in self.runs()), len(self.runs()), plan.count("LeftAnti"), plan.count("Exchange")))
        add(self, batch)

    monkeypatch.setattr(line_dedup.LineRuns, "add", watched)
    line_dedup.drop_common_lines(documents_of(liney), min_docs=4)
    assert len(met) == line_dedup.LEAST_BATCHES > line_dedup.FANOUT
    assert all(rows > 0 and joins == runs and not shuffles for rows, runs, joins, shuffles in met[1:])
    assert len({rows for rows, *_ in met}) > 2
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]
    assert line_dedup.batches_for(10**9) > line_dedup.batches_for(10**6) > line_dedup.LEAST_BATCHES


@pytest.mark.parametrize("batches", [1, 4])
def test_first_document_keeps_its_lines(documents_of, liney, batches):
    docs_of = defaultdict(set)
    for d, t in liney:
        for line in (t or "").split("\n"):
            docs_of[key(line)].add(d)
    left = defaultdict(set)
    for r in line_dedup.drop_common_lines(documents_of(liney), min_docs=4, keep_first=True, batches=batches).collect():
        for line in (r.text or "").split("\n"):
            left[key(line)].add(r.doc_id)
    for k, docs in docs_of.items():
        assert len(left[k]) == (1 if k and len(docs) >= 4 else len(docs))


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, most):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= most and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


@pytest.mark.parametrize("segments", [1, 2, 3, 4])
def test_all_links_are_found(spark, segments):
    rng = random.Random(segments)
    fps = {rng.getrandbits(64) for _ in range(15)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 6))}))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    most = 2 if segments == 1 else 4
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), most, segments).collect()
    want = {frozenset((a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= most}
    assert {frozenset((r.a, r.b)) for r in got} == want


def test_clusters(documents_of, prose):
    rng = random.Random(2)
    texts = []
    for s in range(12):
        base = prose(s, 400).split(" ")
        for _ in range(4):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = "Changed"
            texts.append(" ".join(words))
    texts += ["", None, "one", "ONE", "one two three", " \n"]
    fps = [slow_fingerprint(t) for t in texts]
    label = classes(fps, 4)
    got = {r.doc_id: r for r in simhash.cluster(documents_of(list(enumerate(texts)))).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == label
    kept = sorted(r.doc_id for r in simhash.keep_one(documents_of(list(enumerate(texts)))).collect())
    assert kept == sorted(set(label))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_no_table_of_nodes_or_links_is_broadcast(spark, documents_of, prose, monkeypatch):
    """Spark takes the tables here for small ones, as it does large ones that an explode makes larger."""
    nodes = spark.range(60).select(F.xxhash64("id").alias("fp"))

    def broadcasts(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")

    assert broadcasts(nodes.join(nodes.withColumnRenamed("fp", "b"), F.col("fp") == F.col("b")))
    assert not broadcasts(simhash.links(nodes))
    marked = nodes.select(F.monotonically_increasing_id().alias("doc_id"), "fp")
    assert not broadcasts(simhash.near_components(marked))
    assert not broadcasts(simhash.cluster(documents_of([(i, prose(i)) for i in range(4)])))

    plans, stored = [], components_module.stored
    monkeypatch.setattr(components_module, "stored", lambda df, path: plans.append(broadcasts(df)) or stored(df, path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a bigint, b bigint")
    for few, broadcast in ((0, False), (100, True)):
        plans.clear()
        monkeypatch.setattr(texts, "FEW_ROWS", few)
        assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(13)}
        assert any(plans) == broadcast


def test_shards_are_the_shortest_that_fit(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([10, 50, 400])) for i in range(500)] + [(500, 5000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, n bigint"), size=F.col("n"), shard_bytes=1000).collect()
    shard = {r.doc_id: r.shard for r in got}

    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    size = dict(rows)
    for i, _ in rows:
        assert bits[i].startswith(shard[i])
        for depth in range(len(shard[i]) + 1):
            inside = [j for j in bits if bits[j][:depth] == bits[i][:depth]]
            assert (sum(size[j] for j in inside) <= 1000 or len(inside) == 1) == (depth == len(shard[i]))


def test_hot_key_and_equal_rows_are_split(spark):

    rows = [("hot", f"text {i}") for i in range(300)] + [("same", "equal text")] * 300 + [(None, "x")] * 5
    docs = spark.createDataFrame(rows, "k string, text string").repartition(4)
    got = sharding.assign(docs, key="k", shard_bytes=200).collect()
    assert Counter((r.k, r.text) for r in got) == Counter(rows)
    sums = defaultdict(int)
    for r in got:
        sums[r.shard] += len(r.text)
    assert max(sums.values()) <= 200 and all(sums[r.shard] == r.shard_bytes for r in got)
    assert sharding.directory(sharding.assign(docs, key="k", shard_bytes=200)).agg(F.sum("n_rows")).first()[0] == len(rows)


def test_rounds_leave_one_table_and_make_few_tasks(spark):
    """What a round wrote goes with the round, and its tasks follow its rows, not only the number of partitions."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)], "a bigint, b bigint").cache()
    edges.count()
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    known, tracker = set(Path(work_root(spark)).rglob("part-*")), spark.sparkContext.statusTracker()
    try:
        spark.conf.set(names[0], "40")
        spark.conf.set(names[1], "false")
        spark.sparkContext.setJobGroup("component-rounds", "")
        found = components(edges)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    stages = {s for j in tracker.getJobIdsForGroup("component-rounds") for s in tracker.getJobInfo(j).stageIds}
    done = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    left = set(Path(work_root(spark)).rglob("part-*")) - known
    assert {r.node: r.root for r in found.collect()} == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert len({p.parent for p in left}) == 1 and len(left) <= 40
    assert done < 2000
