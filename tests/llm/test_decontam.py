import re
from collections import defaultdict

from tessera.llm import decontam

from .samples import SCHEMA, frame, texts

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII))


def brute(documents, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 7)) if w else []:
            windows[tuple(w[k : k + 8])].add(str(item))
    out = []
    for text in documents:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), sorted(hit), sorted(found)))
    return out


ITEMS = [(1, "Alpha beta, gamma delta: epsilon zeta eta theta iota kappa"), (2, "beta gamma delta epsilon zeta eta theta iota"), (3, "short one"), (10, None), (11, ""), (12, "... !"), (13, "é日 ü")]
TEXTS = [*texts(n=12), "x ALPHA beta-gamma delta (epsilon) zeta eta; theta iota kappa y", "a Short ONE b short one", "shortone", "é日 ü É日 ü", "alpha beta gamma delta epsilon zeta eta"]


def test_as_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(TEXTS, ITEMS)
    for block in (1 << 20, 10):
        got = sorted(decontam.contaminated_words(frame(spark, TEXTS), items, block_bytes=block).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, list(r.hit_words), list(r["items"])) for r in got] == want
        for r in got:
            text = (TEXTS[r.doc_id] or "").encode()
            own = [w for s in r.spans for w in words(text[s.start : s.end].decode())]
            assert own == [words(TEXTS[r.doc_id])[k] for k in r.hit_words]
        kept = {r.doc_id for r in decontam.decontaminate(frame(spark, TEXTS), items, 2, block_bytes=block).collect()}
        assert kept == {i for i, (_, _, found) in enumerate(want) if len(found) < 2}


def test_empty_tables(spark):
    items, none = spark.createDataFrame(ITEMS, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated_words(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert decontam.decontaminate(frame(spark, TEXTS), none).count() == len(TEXTS)


def test_rows_of_one_id_stay_apart_at_every_block_size(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "short one here"), (1, "nothing"), (None, "short one"), (None, None)], "doc_id long, text string")
    told = [sorted((r.doc_id or 0, r.n_words, list(r["items"])) for r in decontam.contaminated_words(docs, items, block_bytes=block).collect()) for block in (1 << 20, 10)]
    assert told[0] == told[1] == [(0, 0, []), (0, 2, ["3"]), (1, 1, []), (1, 3, ["3"])]


def test_one_short_item_is_not_enough(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    every = ["a short one b", "short one and é日 ü", "beta gamma delta epsilon zeta eta theta iota", "clean", None]
    for block in (1 << 20, 10):
        kept = decontam.decontaminate(frame(spark, every), items, whole_window=True, block_bytes=block)
        assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4] and kept.columns == frame(spark, []).columns
