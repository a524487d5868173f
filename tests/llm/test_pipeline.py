"""The whole pipeline, and the two trained scorers, against plain Python."""

import collections
import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import SMALL, WORD, components, least_capacity

from argentic.llm import _anchors, _features, language_id, quality_classifier
from argentic.llm._common import load

ALL = (1 << 64) - 1


def char_buckets(text, n, bits):
    points = [ord(c) for c in text.lower()]
    out = []
    for i in range(len(points) - n + 1):
        code = 0
        for c in points[i : i + n]:
            code = (code * int(_features._STEP) + c) & ALL
        out.append(((code + n) * 0x9E3779B97F4A7C15 & ALL) >> 64 - bits)
    return out


def word_buckets(text, bits):
    def mixed(x):
        return int(_anchors.mix(np.array([x & ALL], dtype=np.uint64))[0])

    out, last = [], None
    for w in WORD.findall(text.lower()):
        key = mixed(mixed(sum(mixed(ord(c) + 1) * pow(_anchors._BASE, i, 1 << 64) for i, c in enumerate(w))) + 0x57)
        out += [key >> 64 - bits] + [0] * (key == last)
        last = key
    return out


def quality_buckets(text):
    return word_buckets(text, quality_classifier.BITS) + [b for n in quality_classifier.GRAMS for b in char_buckets(text, n, quality_classifier.BITS)]


def quality_score(text, values):
    found = quality_buckets(text or "")
    return 1 / (1 + math.exp(-(sum(values[b] for b in found) / (len(found) + quality_classifier.PADDING) + values[-1])))


def test_quality_scores(spark, sf):
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    values = np.frombuffer(quality_classifier.fit(docs, labels, F.lit(True))).tolist()
    for r in quality_classifier.classify(docs, labels).collect():
        assert math.isclose(r["score"], quality_score(r["text"], values), abs_tol=1e-9)
        assert r["predicted"] == (r["score"] >= 0.7)


def test_gradient_descent_by_loops(monkeypatch):
    texts, labels = ["a good long text", "bad bad bad", "another fine text é", "", "bad"], [1, 0, 1, 0, 0]
    monkeypatch.setattr(quality_classifier, "PASSES", 3)
    scores, bias = quality_classifier.train([t.encode() for t in texts], np.array(labels))
    rng, size = np.random.default_rng(7), quality_classifier.VECTOR
    table = rng.uniform(-1 / size, 1 / size, (1 << quality_classifier.BITS, size)).tolist()
    out, shift = [[0.0, 0.0] for _ in range(size)], [0.0, 0.0]
    shares = []
    for t in texts:
        n = collections.Counter(quality_buckets(t))
        shares.append({b: c / (n.total() + quality_classifier.PADDING) for b, c in n.items()})
    for done in range(3):
        step = quality_classifier.STEP * (1 - done / 3)
        for i in rng.permutation(len(texts)):
            mean = [sum(s * table[b][j] for b, s in shares[i].items()) for j in range(size)]
            z = [sum(mean[j] * out[j][k] for j in range(size)) + shift[k] for k in range(2)]
            p = [math.exp(x - max(z)) for x in z]
            error = [x / sum(p) - (k == labels[i]) for k, x in enumerate(p)]
            back = [sum(out[j][k] * error[k] for k in range(2)) for j in range(size)]
            for j in range(size):
                out[j] = [out[j][k] - step * mean[j] * error[k] for k in range(2)]
            shift = [shift[k] - step * error[k] for k in range(2)]
            for b, s in shares[i].items():
                table[b] = [x - step * len(shares[i]) ** 0.5 * s * back[j] for j, x in enumerate(table[b])]
    assert math.isclose(bias, shift[1] - shift[0], abs_tol=1e-4)
    for b in {b for s in shares for b in s}:
        assert math.isclose(scores[b], sum(table[b][j] * (out[j][1] - out[j][0]) for j in range(size)), abs_tol=1e-4)


def test_languages_by_dictionaries(spark, sf):
    docs = load(spark, sf, "documents")
    rows = docs.collect()
    seen, priors = collections.defaultdict(collections.Counter), collections.Counter()
    found = {r["doc_id"]: [b for n in language_id.GRAMS for b in char_buckets(r["text"] or "", n, language_id.BITS)] for r in rows}
    for r in rows:
        if r["lang"] is not None and r["text"] is not None:
            priors[r["lang"]] += 1
            seen[r["lang"]].update(found[r["doc_id"]])
    total = {x: seen[x].total() + language_id.PRIOR * (1 << language_id.BITS) for x in priors}
    letters = {r["doc_id"]: any(c.isalpha() for c in r["text"] or "") for r in rows}
    for r in language_id.identify(docs).collect():
        if not letters[r["doc_id"]]:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        logs = {x: math.log(priors[x] / priors.total()) + sum(math.log((seen[x][b] + language_id.PRIOR) / total[x]) for b in found[r["doc_id"]]) for x in priors}
        best = max(logs, key=logs.get)
        assert r["lang_pred"] == best
        assert math.isclose(r["score"], 1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs_tol=1e-3)


def text_hash(text):
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def shingles(text, width=5):
    ws = WORD.findall((text or "").translate(SMALL))
    n = min(width, len(ws))
    return n, {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if ws else set()


def one_of_each(rows):
    """Rows (doc_id, text, ...): the least of each group of texts that are alike."""
    texts = {text_hash(r[1]): r[1] for r in rows}
    sets = {h: shingles(t)[1] for h, t in texts.items()}
    roots = components(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    least = {}
    for r in rows:
        rank = (r[0] is None, r[0] or 0, text_hash(r[1]))
        root = roots[rank[2]]
        least[root] = min(least.get(root, (rank, r)), (rank, r), key=lambda x: x[0])
    return [r for _, r in least.values()]


def without_items(rows, items):
    wanted = [(n, s) for n, s in map(shingles, items) if s]
    return [r for r in rows if not any(len(s & shingles(r[1], n)[1]) >= math.ceil(0.8 * len(s) - 1e-9) for n, s in wanted)]


def targets(size):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    capped = set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        open_ = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * n if s in capped else left * weight[s] / open_ for s, n in size.items()}
        over = {s for s in size if target[s] > 3 * size[s] + 1e-9}
        if not over:
            return target
        capped |= over


def mixed(rows):
    """Rows as often as the mix takes them: places along each source's line of words."""
    names = [hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest() for r in rows]
    words = [len(WORD.findall(r[1] or "")) for r in rows]
    size = collections.Counter()
    for r, n in zip(rows, words, strict=True):
        size[r[3]] += n
    target, out = targets(size), collections.Counter()
    for r, n, name in zip(rows, words, names, strict=True):
        rate = min(target[r[3]] / size[r[3]], 3.0) if size[r[3]] else 1.0
        before = sum(m for q, m, other in zip(rows, words, names, strict=True) if q[3] == r[3] and other[:15] < name[:15])
        out[r] += math.floor(rate) + (before + int(name[15:23], 16) / 2**32 * n < (rate - math.floor(rate)) * size[r[3]])
    return +out


@pytest.fixture(scope="module")
def planted(spark, sf, tmp_path_factory):
    """The small tables with near copies, repeats, benchmark passages, and nulls in every column."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, items = load(spark, sf, "documents"), load(spark, sf, "benchmark")
    good = [r["text"] for r in quality_classifier.classify(docs, load(spark, sf, "labels")).filter("score > 0.95 and n_chars > 600").orderBy("doc_id").limit(8).collect()]
    item = items.filter("length(text) > 20").orderBy("item_id").first()["text"]
    half = [" ".join(t.split()[: len(t.split()) // 2]) for t in good]
    rows = [(9000 + i, t + " one more", "en", "copies", None) for i, t in enumerate(good[:3])]
    rows += [(9010, half[3] + " " + good[4], "en", None, 7)] * 2
    rows += [(None, half[4] + " " + good[5], None, "s", 1), (None, half[5] + " " + item + " " + good[6], "en", "s", 1), (9011, half[6] + " " + item + " " + good[7], "en", None, 1)]
    rows += [(9011, half[7] + " " + good[6] + " " + half[2], "en", "copies", 1), (9012, None, None, None, None), (None, None, None, None, None), (9013, "", "en", "s", 0), (9014, " \n", "en", "blank", 2)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    items.unionByName(spark.createDataFrame([(None, item), (77, None), (78, " ")], items.schema)).write.parquet(f"{folder}/benchmark.parquet")
    labels = load(spark, sf, "labels")
    labels.unionByName(spark.createDataFrame([(None, 1, None), (9012, 0, None), (9013, None, 0)], labels.schema)).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_by_brute_force(spark, planted):
    import corpus_pipeline

    docs, labels = load(spark, planted, "documents"), load(spark, planted, "labels")
    rows = [tuple(r) for r in docs.collect()]
    values = np.frombuffer(quality_classifier.fit(docs, labels, F.lit(True))).tolist()
    good = [r for r in rows if quality_score(r[1], values) >= 0.7]
    apart = one_of_each(good)
    clean = without_items(apart, [r["text"] for r in load(spark, planted, "benchmark").collect()])
    assert len(rows) > len(good) > len(apart) > len(clean) > 20
    found = corpus_pipeline.run(spark, planted).collect()
    assert collections.Counter(tuple(r)[:5] for r in found) == mixed(clean)
    shard, size = collections.defaultdict(set), collections.Counter()
    for r in found:
        shard[text_hash(r["text"])].add(r["shard"])
        size[text_hash(r["text"])] += len((r["text"] or "").encode()) + 1
    order = sorted(shard)
    assert all(len(x) == 1 for x in shard.values())
    cuts = [min(shard[h]) for h in order]
    assert cuts == sorted(cuts) and 0 <= cuts[0] and cuts[-1] <= 15
    held = collections.Counter()
    for h in order:
        held[min(shard[h])] += size[h]
    assert max(held.values()) == least_capacity([size[h] for h in order], 16)


def test_run_over_an_empty_table(spark, planted, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark", "labels"):
        load(spark, planted, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() == 0 and found.columns == [*load(spark, planted, "documents").columns, "shard"]
