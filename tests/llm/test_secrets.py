import hashlib
import random
import re

from pyspark.sql import functions as F

from tempaudit.llm import secrets
from tempaudit.llm.secrets import scan

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|(?a:(?i:secret|token|api_?key)))["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)]


def secret(rng, kind):
    if kind == 0:
        return f"{rng.choice(['Password', 'token', 'api_key', 'APIKEY', 'paſsword'])}{rng.choice(['=', ': ', '\" : '])}{''.join(rng.choices('abcXYZ019+/', k=rng.randint(3, 30)))}"
    if kind == 1:
        return "AKIA" + "".join(rng.choices("ABCDEF0123456789", k=rng.choice([9, 16, 16, 17])))
    return "".join(rng.choices("0123456789abcdef", k=rng.choice([20, 32, 40])))


def noise(rng):
    return rng.choice([f"{rng.randint(10**15, 10**16)}", f"x.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", f"2024-01-{rng.randint(10, 28)}T10:00", "secret: token: abcdefgh"])


def test_spans_and_held_out_accuracy(docs, odd_texts):
    rng, texts = random.Random(5), list(odd_texts)
    for i in range(500):
        words = rng.choices(["été", "the", "数据", "of"], k=12)
        words.insert(rng.randint(0, 12), secret(rng, i % 3))
        words.insert(rng.randint(0, 12), noise(rng))
        texts.append(" ".join(words))
    texts.append("key abc\n" + "ghp_" + "".join(rng.choices("abcdefXYZ0189", k=36)) + "\nx" * 30000)
    table = docs(texts).withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in scan(table).collect()}
    again = {r.doc_id: r for r in scan(table.repartition(7)).collect()}
    false_alarms = 0
    for i, text in enumerate(texts):
        base, r = brute(text), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [s for s in r.spans.split(",") if s and not s.startswith("model")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex"))
        for s in filter(lambda s: s.startswith("model"), r.spans.split(",")):
            _, a, b = s.split(":")
            false_alarms += bool(re.search("@|^2024|^[0-9]{16}$", text[int(a):int(b)]))
        assert r.spans == again[i].spans
    assert false_alarms <= 25  # of 500 addresses, dates and numbers
    assert got[len(texts) - 1].top_score is not None


def test_no_findings_and_empty(docs, empty_docs):
    assert scan(empty_docs).count() == 0
    r = scan(docs(["a token=abcdef1", None])).orderBy("doc_id").collect()
    assert r[0].spans == "assign:2:15" and r[1].spans == "" and r[0].top_score is None
    few = scan(docs(["one ordinarycandidate here", "one ordinarycandidate here"]).withColumn("doc_id", F.lit(4))).collect()
    assert len(few) == 2 and few[0] == few[1] and few[0].top_score is not None


def planted(rng, kind):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda n, chars=letters: "".join(rng.choices(chars, k=n))
    return ("ghp_" + pick(36), pick(40), "sk-" + pick(32), pick(32, "abcdefghijklmnopqrstuvwxyz"))[kind]


def test_secrets_without_a_keyword_are_found_in_the_given_table(spark):
    rng = random.Random(9)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    where, texts = {}, []
    for n, (i, text) in enumerate(rows):
        words = (text or "").split(" ")
        if n % 4 == 0:
            at = rng.randint(0, len(words))
            value = planted(rng, n // 4 % 4)
            words.insert(at, value)
            start = len(" ".join(words[:at])) + (1 if at else 0)
            where[i] = (n // 4 % 4, f"model:{start}:{start + len(value)}")
        texts.append((i, " ".join(words)))
    got = {r.doc_id: r for r in scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    hits = [[], [], [], []]
    for i, (kind, span) in where.items():
        hits[kind].append(span in got[i].spans.split(","))
    assert min(sum(h) / len(h) for h in hits) >= 0.9, [sum(h) / len(h) for h in hits]
    extra = sum(r.n_model for r in got.values()) - sum(map(sum, hits))
    assert extra <= 40, extra  # one in a hundred of the 4,000 candidates of 1,000 documents


def test_a_secret_is_read_to_its_end(docs):
    rng = random.Random(3)
    plain = [" ".join(rng.choices(["undeinzuente", "thatanheheen", "lesaimenttrevi", "the", "of"], k=30)) for _ in range(60)]
    tail = "z" * 60 + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=240))
    rows = scan(docs([*plain, "x " + tail + " y"])).orderBy("doc_id").collect()
    assert rows[-1].spans == f"model:2:{2 + len(tail)}"


def test_networks_learn_from_every_finding_and_candidate(docs):
    rng = random.Random(4)
    value = lambda n, letters: "".join(rng.choices(letters, k=n))
    texts = [f"the token={value(24, 'abcXYZ019')} of {value(16, 'aeinrst')} and {value(14, 'aeinrst')} end" for _ in range(3600)]
    found = secrets.scan_base(docs(texts), "text", "doc_id")
    groups, n = secrets.grouped(found, 2000)
    assert n > 1
    held = list(secrets.unpacked(iter(groups.toArrow().to_batches())))
    assert sum(len(f[0]) for _, f, _ in held) == 3600 and sum(len(h[0]) for _, _, halves in held for h in halves) == 7200
    for number, theirs, halves in held[:2]:
        parts = [secrets.lesson(number, theirs, halves, own, turn, 4) for own in (0, 1) for turn in range(4)]
        assert sum(len(plain[0]) for _, plain in parts) == sum(len(h[0]) for h in halves)
        assert all(len(x) >= len(theirs[0][turn % 4::4]) for turn, ((x, _), _) in enumerate(parts))
    nets, again = secrets.train(found, group=2000), secrets.train(found.repartition(5), group=2000)
    scores = secrets.counted_scores(groups, nets, 4, True)
    assert sum(int(counts[kind == secrets.PLAIN].sum()) for kind, _, counts in scores) == 7200  # every candidate has a say in the threshold
    assert abs(nets[0].threshold - again[0].threshold) < 1e-3


def test_groups_do_not_depend_on_the_number_of_shuffle_partitions(docs, monkeypatch):
    """Each group costs made findings and fits of its own, so more partitions must not make more groups."""
    rng = random.Random(8)
    value = lambda n: "".join(rng.choices("aeinrst", k=n))
    found = secrets.scan_base(docs([f"the token={value(24)} of {value(16)} and {value(14)} end" for _ in range(600)]), "text", "doc_id")
    few = secrets.grouped(found, 600)
    wide = type(found).repartition
    monkeypatch.setattr(type(found), "repartition", lambda df, n, *by: wide(df, 40, *by) if isinstance(n, int) else wide(df, n, *by))
    many = secrets.grouped(found, 600)
    rows = [sorted(bytes(r.rows) for r in groups.collect()) for groups, _ in (few, many)]
    assert few[1] == many[1] == len(rows[0]) and rows[0] == rows[1]
