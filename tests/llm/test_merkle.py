import hashlib
import zlib

import pytest

from grainmill.llm import merkle
from grainmill.llm.common import cut
from grainmill.llm.places import placed

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, at string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(built, at):
    """From each level (place, the run's other nodes)."""
    out = []
    for nodes in built[:-1]:
        run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
        out.append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
        at //= 3
    return out


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for d, s, lang, n, t in rows:
        leaf = h(*map(field, (d, s, lang, n, t)))
        hit = d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None
        by_source.setdefault(s, []).append((d is not None, d or 0, leaf, h(*map(field, (d, s, lang, n, t.replace("\n", "") if hit else t)))))
    order = sorted(by_source, key=lambda s: b"" if s is None else b"1" + s.encode())
    built = {s: levels([x[2] for x in sorted(by_source[s])]) for s in order}
    over = levels([built[s][-1][0] for s in order])
    out = []
    for i, s in enumerate(order):
        for at, (known, d, leaf, given) in enumerate(sorted(by_source[s])):
            steps, node = path(built[s], at) + path(over, i), given
            for place, others in steps:
                node = h(*others[:place], node, *others[place:])
            out.append((d if known else None, leaf, built[s][-1][0], over[-1][0], h(*[x for _, others in steps for x in others]), node, node == over[-1][0]))
    return sorted(out, key=str)


def same(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    got = merkle.manifest(df, **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 81, 82, 100, 730])
def test_traversal_gives_every_path_in_turn(n):
    leaves = [h(str(i)) for i in range(n)]
    built = levels(leaves)
    height = len(built) - 1
    got = list(merkle.traverse([x.encode() for x in leaves], height))
    assert [[(p, [o.decode() for o in others]) for p, others in steps] for steps in got] == [path(built, i) for i in range(n)]
    assert merkle.tree_root([x.encode() for x in leaves], height).decode() == built[-1][0]
    assert all(merkle.unpacked(merkle.packed(steps)) == steps for steps in got)


def test_stacks_are_logarithmic():
    hashed, most = merkle.Treehash(7), 0
    for i in range(3**7):
        hashed.push(h(str(i)).encode())
        most = max(most, sum(map(len, hashed.pending)))
    assert most <= 2 * 7


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 9, 10], [100, 1, 28, 81], [1] * 40])
def test_same_as_brute_force_over_several_levels(spark, sizes):
    rows = [(1000 * s + i, f"s{s}", "en", i, f"text {i}\nof {s}") for s, n in enumerate(sizes) for i in range(n)]
    same(spark, sorted(rows, key=lambda r: h(str(r[0]))), height=2)


def test_whole_blocks_of_production_size(spark):
    same(spark, [(i, "hot" if i % 3 else None, None, None, "a\nb" if i % 2 else "ab") for i in range(7000)])


def test_nulls_repeated_rows_and_odd_texts(spark):
    rows = [(None, None, None, None, None)] * 30 + [(5, "", "", 0, "")] * 3 + [(5, "é\n", "de", -1, "\n" * 50)] * 12 + [(i, None, "x", i, None) for i in range(20)]
    rows += [(-3, "1", "-", 2**62, "x" * 500_000 + "\n"), (4, "0", "fr", 1, "\U0001f600\r\n"), (4, "0", "fr", 1, "other")]
    same(spark, rows, height=2)


def test_empty_table(spark):
    same(spark, [])


def test_places_and_running_sums_over_partitions(spark):
    rows = [(k, (i * 7919) % 1000, i - 500) for k, n in ((None, 300), (1, 5), (2, 2000), (3, 1)) for i in range(n)]
    df = cut(spark.createDataFrame(rows, "k long, o long, v long").repartition(7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(df, ["k"], [df.o.asc()], ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, n in ((None, 300), (1, 5), (2, 2000), (3, 1)):
        own = sorted((r for r in got if r.k == k), key=lambda r: r["at"])
        assert [r["at"] for r in own] == list(range(n)) and [r.o for r in own] == sorted(r.o for r in own)
        total = 0
        for r in own:
            assert r.v_before == total
            total += r.v
            assert r.v_sum == total


def test_query_reads_the_table(spark, tmp_path):
    rows = [(i, f"s{i % 4}", "en", i, f"{i}\nx") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str) == brute(rows)
