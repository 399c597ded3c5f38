import hashlib
import random
import re

from tessera.llm import pii

from .samples import SCHEMA, frame, texts

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(found):
    total = 0
    for i, c in enumerate(reversed([int(c) for c in found if c.isdigit()])):
        d = c * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def good(kind, found):
    n = len(re.findall("[0-9]", found))
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in found.split(".")), "card": 12 <= n <= 19 and luhn(found), "phone": 9 <= n <= 15}[kind]


def brute(text):
    return sorted((m.start(), pii.KINDS.index(kind) + 1, m.end()) for kind, p in BASE.items() for m in re.finditer(p, text or "") if good(kind, m.group()))


def tricky(rng):
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y+z@mail-1.example.com.", "@no.where", "1.2.3.4", "300.1.1.1.1", "1.2.3.4.5.6.7.8", "0255.007.1.09", "4111 1111 1111 1111", "4111-1111 11111111", "4111111111111112", "411111111111111", "+1 (017) 555-7713", "+12345678", "+123456789", "+1234567890123456", "+1.2.3.4.5.6.7.8.9.10", "++49 170 1234567", "12 34 56", "é", "日本", " ", "  ", "-", "x", "\n", "7", "1234567890123 4", "9" * 30]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "-", "."]) for _ in range(rng.randint(1, 9))) for _ in range(400)]


def test_base_as_brute_force(spark):
    every = [*texts(n=12), *tricky(random.Random(3)), "a" * 20000 + "@", "1" * 20000, "+" + "1 " * 5000, "1.2.3.4 " * 1500]
    docs = frame(spark, every)
    found = pii.personal_data(docs.union(docs.limit(5)))
    rows = found.select("doc_id", "base", "spans", pii.text_of("base").alias("told")).collect()
    assert len(rows) == len(every) + 5
    for r in rows:
        want = brute(every[r.doc_id])
        assert [tuple(s) for s in r.base or []] == want, every[r.doc_id][:200]
        assert hashlib.sha256(r.told.encode()).hexdigest() == hashlib.sha256(",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert {tuple(s) for s in r.spans or []} >= set(want)


def test_context_adds_spans_and_plain_numbers_stay(spark):
    every = [f"Please call phone: 555-{100 + i}-{2000 + i} or mail: user{i}@mail.example.com now" for i in range(60)]
    every += [f"Write to e-mail some{i} [at] example [dot] com today" for i in range(60)]
    every += [f"the order no 555-{100 + i}-{2000 + i} and serial 4111111111111{i:03d}" for i in range(40)]
    rows = pii.personal_spans(frame(spark, every)).collect()
    added = [r for r in rows if not r.base]
    assert {r.kind for r in added} == {"email", "phone"} and all(r.doc_id < 120 for r in added)
    assert len({r.doc_id for r in added}) == 120
    done = {r.doc_id: r.text for r in pii.redact(frame(spark, every[:1] + every[60:61] + ["no data é", None])).collect()}
    assert done[2] == "no data é" and done[3] is None and "[EMAIL]" in done[0] and "@" not in done[0]


def test_em_orders_labelers_by_reliability():
    rng = random.Random(1)
    counts = {}
    for _ in range(20000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) if rng.random() < p else (-1 if y else 1) for p in (0.95, 0.85, 0.7, 0.6, 0.55))
        counts[v, y] = counts.get((v, y), 0) + 1
    both = {}
    for (v, y), n in counts.items():
        both.setdefault(v, [0, 0])[y] += n
    patterns = [("card", v, 0, sum(n)) for v, n in sorted(both.items())]
    tables, post = pii.estimate(patterns)
    right = sum(n[p > 0.5] for (_, n), p in zip(sorted(both.items()), post, strict=True))
    assert right > 0.93 * 20000
    assert [t[1][1] for t in tables] == sorted((t[1][1] for t in tables), reverse=True)


def test_native_and_empty(spark):
    out = pii.personal_data(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_form_of_an_obfuscated_address_is_a_candidate(spark):
    every = [f"mail: john{at}example{dot}com" for at in ("[at]", " (at) ", " at ") for dot in ("[dot]", " (dot) ", " dot ")]
    rows = pii.candidates(frame(spark, every)).where("wide and kind = 'email'").collect()
    assert {r.doc_id: r.found for r in rows} == {i: t[len("mail: ") :] for i, t in enumerate(every)}


def test_very_long_runs_and_many_matches(spark):
    labels, many, digits = "a@b" + ".c" * 500_000, "x@y.zz, " * 20_000, "1." * 10_000 + "+" + "( " * 200_000
    rows = {r.doc_id: r for r in pii.personal_data(frame(spark, [labels, many, digits, "u [at] h" + " [dot] c" * 3000])).collect()}
    assert [tuple(s) for s in rows[0].base] == [(0, 1, len(labels))]
    assert len(rows[1].base) == 20_000 and tuple(rows[1].base[-1]) == (8 * 19_999, 1, 8 * 19_999 + 6)
    assert [tuple(s) for s in rows[2].base or []] == brute(digits[:20_000])


def test_rows_without_an_id_or_with_one_id(spark):
    docs = spark.createDataFrame([(None, "mail a@b.co"), (1, "x a@b.co"), (1, "nothing"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, [tuple(s) for s in r.base or []]) for r in pii.personal_data(docs).collect())
    assert got == [(0, []), (0, [(5, 1, 11)]), (1, []), (1, [(2, 1, 8)])]
    done = sorted((r.doc_id or 0, r.text or "") for r in pii.redact(docs).collect())
    assert done == [(0, ""), (0, "mail [EMAIL]"), (1, "nothing"), (1, "x [EMAIL]")]


def test_wide_candidates_as_brute_force(spark):
    rng = random.Random(7)
    parts = ["(555) 123-4567", "555-123-4567", "555 123 4567", "joe at mail dot com", "joe[at]x[dot]y [dot] z", "2001:0db8:0:0:0:0:0:1", "1:2:3", "x", "9", ".", " ", "-", "(", "é"]
    every = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    got = {}
    for r in pii.candidates(frame(spark, every)).where("wide").collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.start, r.end, r.found))
    for i, text in enumerate(every):
        assert got.get(i, set()) == {(k, m.start(), m.end(), m.group()) for k, p in pii.WIDE.items() for m in re.finditer(p, text)}, text


def test_the_classifier_decides_alone(spark):
    every = [f"Please call phone: +1 555 {100 + i} {2000 + i} today or phone: 555-{100 + i}-{2000 + i}" for i in range(40)]
    every += [f"order no 555-{100 + i}-{2000 + i}" for i in range(40)]
    scored = pii.personal_spans(frame(spark, every), accept=0.0).collect()
    likely = {r.doc_id: r.probability for r in scored if not r.base}
    assert min(likely[i] for i in range(40)) > max(likely[i] for i in range(40, 80))
