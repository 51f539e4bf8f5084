import hashlib
import random

from helpers import SCHEMA, with_clashes
from pyspark.sql import functions as F

from loomline.llm import merkle_strings


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3 - 1], row[2 - 1], row[3], row[4])))


def climb(nodes):
    """The top of a list of nodes, and each one's siblings from below (left and right of it)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p - p % 3
            paths[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
        at = [p // 3 for p in at]
        nodes = [digest("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, lang, source, n_chars, text), in plain Python."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = climb([x[1] for x in groups[s]])
    root, above = climb([trees[s][0] for s in order])
    return sorted((d if d is not None else -1, h, trees[s][0], root, tuple(own + above[k])) for k, s in enumerate(order) for (d, h), own in zip(groups[s], trees[s][1], strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(d, text, lang, source, n) for d, lang, source, n, text in rows], SCHEMA)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in df.collect())


def test_every_path_equals_a_walk_of_the_tree(spark):
    rng = random.Random(5)
    # one source of several blocks, one that fills a block, one of one row, a null one, and some of few
    sizes = {"hot": 2 * merkle_strings.BLOCK + 31, "block": merkle_strings.BLOCK, "one": 1, None: 7, "": 3, "Zé": 4, "z": 10}
    rows = [(rng.randrange(10**6), rng.choice(["en", None]), s, rng.choice([3, None]), rng.choice(["é text\n", "", None, f"{k} words"])) for s, n in sizes.items() for k in range(n)]
    rows += [(None, "en", "z", 1, "no id"), (None, None, "z", None, None), (7, "en", "z", 1, "same"), (7, "en", "z", 1, "same"), (7, "de", "z", 1, "same")]
    rng.shuffle(rows)
    made = found(merkle_strings.manifest(with_clashes(frame(spark, rows)).repartition(5)))
    assert made == brute(rows)
    assert len({len(p) for *_, p in made}) > 3


def test_many_sources_are_a_tree_of_several_blocks(spark):
    rows = [(k, "en", f"s{k // 2}", 1, str(k)) for k in range(2 * merkle_strings.BLOCK + 9)]
    assert found(merkle_strings.manifest(frame(spark, rows))) == brute(rows)


def test_one_row_is_its_own_root_and_none_has_no_root(spark):
    rows = [(3, "en", "a", 1, "x")]
    one = merkle_strings.manifest(frame(spark, rows)).withColumn("proof", merkle_strings.proof_digest(F.col("path"))).first()
    assert one.leaf == one.subroot == one.root == leaf(rows[0]) and one.path == [] and one.proof == digest("")
    assert merkle_strings.manifest(frame(spark, rows).limit(0)).collect() == []


def test_tampered_leaves_lead_elsewhere(spark):
    rows = [(k, "en", f"s{k % 3}", 1, f"text {k}\n" if k % 2 else f"text {k}") for k in range(40)]
    fields = {c: F.col(c) for c in merkle_strings.FIELDS}
    other = merkle_strings.leaf(**fields | {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    made = merkle_strings.manifest(frame(spark, rows), {"other": other})
    checked = made.select("doc_id", (merkle_strings.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"), (merkle_strings.folded(F.col("other"), F.col("path")) == F.col("root")).alias("cut")).collect()
    assert all(r.own and r.cut == (r.doc_id % 2 == 0) for r in checked) and len(checked) == 40
