import hashlib
import random
import string

from helpers import awkward_rows, docs_frame, with_clashes

from loomline.llm import secret_novelty

PROSE = "the server reads its configuration before any request is handled and writes a report about every connection that failed "


def spans(row):
    return [(s.kind, s.start, s.end) for s in row.spans]


def scanned(spark, rows, known=("server", "configuration", "request", "connection")):
    return {r.doc_id: r for r in secret_novelty.scan(with_clashes(docs_frame(spark, rows)), list(known)).collect()}


def test_base_patterns(spark):
    key = "AKIA" + "Z" * 16
    cases = {
        1: ('x password = "abcdef" y', [("assign", 2, 21 - 1)]),
        2: ("Token:abc; API_KEY='abcdefg", [("assign", 11, 27)]),
        3: (f"{key} AKIA{'Q' * 15} {'0a' * 12} {'f' * 23}", [("access", 0, 20), ("hex", 41, 65)]),
        4: ("secret: token :abcdefgh", []),  # the first match has five characters, and the second would lie in it
        5: ("paſſword=abcdefgh toKen=abcdefgh", []),  # letters of ASCII alone fold
        6: ('é token="' + "ab12" * 10 + '"', [("assign", 2, 49), ("hex", 9, 49)]),
        7: ("TOKEN=" + "A" * 6 + " passwd=secret=abc", [("assign", 0, 12), ("assign", 13, 30)]),
    }
    found = scanned(spark, [(k, t) for k, (t, _) in cases.items()])
    assert {k: spans(r) for k, r in found.items()} == {k: want for k, (_, want) in cases.items()}
    assert all([(s.kind, s.start, s.end) for s in r.base] == cases[k][1] for k, r in found.items())


def test_random_strings_in_sensitive_places_are_found_and_names_are_not(spark):
    rng = random.Random(11)
    made = lambda n: "".join(rng.choice(string.ascii_letters + string.digits + "+/") for _ in range(n))
    known = sorted({w for w in PROSE.split() if len(w) >= 4})
    keys = [made(rng.choice((24, 32, 40, 64))) for _ in range(100)]
    rows = [(k, f"{PROSE}client_key for it is <{s}> {PROSE}") for k, s in enumerate(keys)]
    rows += [(1000 + k, f"{PROSE}{s} {PROSE}") for k, s in enumerate(keys)]  # no sensitive word
    names = ["_".join(rng.choice(known) for _ in range(4)) + "_v2" for _ in range(100)] + ["server1server1server1server1"]
    rows += [(2000 + k, f"{PROSE}private {s} {PROSE}") for k, s in enumerate(names)]
    found = scanned(spark, rows, known)
    hits = sum(("novel", len(PROSE) + 22, len(PROSE) + 22 + len(s)) in spans(found[k]) for k, s in enumerate(keys))
    assert hits >= 90
    assert sum(bool(found[1000 + k].spans) for k in range(100)) == 0
    assert sum(bool(found[2000 + k].spans) for k in range(len(names))) <= 5


def test_a_key_that_stands_there_twice_is_still_new(spark):
    key = "q7Zt+Lx2Vb9/RwKe5YmNc4Hd8SgUj3Pa"
    row = scanned(spark, [(1, f"{PROSE}bearer {key} and again bearer {key}.")])[1]
    assert [s.kind for s in row.spans] == ["novel", "novel"]


def test_novel_spans_stay_clear_of_base_spans_and_rows_of_each_other(spark):
    rows = [(k, t) for k, (_, t) in enumerate(awkward_rows())]
    key = "q7Zt+Lx2Vb9/RwKe5YmNc4Hd8SgUj3Pa"
    rows += [(50, f"secret token={key}"), (51, f"secret token={key}"), (None, f"bearer {key}")]
    found = scanned(spark, rows)
    assert spans(found[50]) == spans(found[51]) == [("assign", 7, 45)] and [s.kind for s in found[None].spans] == ["novel"]
    assert all(r.spans == [] for k, r in found.items() if k is not None and k < 50) and len(found) == len(rows)
    assert secret_novelty.scan(docs_frame(spark, [(1, "x")]).limit(0), []).count() == 0
    assert [s.kind for s in scanned(spark, [(1, f"bearer {key}")], ())[1].spans] == ["novel"]  # without a dictionary


def test_identifiers_are_counted_by_document_over_all_of_them(spark):
    rows = [(1, "alpha alpha alpha beta"), (2, "beta gamma é"), (3, "beta gamma abc"), (4, None), (5, "x" * 30)]
    assert secret_novelty.identifiers(docs_frame(spark, rows)) == ["beta", "gamma"]
    assert secret_novelty.identifiers(docs_frame(spark, rows), 1) == ["beta"]


def test_the_query_tells_counts_and_digests(spark):
    from loomline.llm import queries

    found = queries.op12_secret_novelty(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        base = ",".join(f"{secret_novelty.KINDS[k]}:{s}:{e}" for s, k, e in secret_novelty.base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))
