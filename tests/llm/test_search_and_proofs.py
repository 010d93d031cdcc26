"""Exact top-k, the Merkle manifest and the prefix trie against brute force."""

import functools
import hashlib
import math
import random
import zlib
from fractions import Fraction

from albumforge.llm.merkle import tampered_manifest
from albumforge.llm.prefix_trie import prefix_trie
from albumforge.llm.tiled_topk import exact_top_k

LONGEST = (1 << 63) - 1


def text_key(row):
    return tuple(str(x) for x in row)


def vectors(seed=1, n=600):
    """Ties, repeated and null ids, several widths, empty vectors, nulls, non-finite and huge components."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([0.0, 0.5, -0.25, 1.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([4, 4, 4, 0, 7]))]
        if rng.random() < 0.05:
            v = None
        elif v and rng.random() < 0.03:
            v[0] = rng.choice([None, math.nan, math.inf, 1e300, -1e19, 1e12])
        rows.append((rng.choice([i, i, i, None, 50, 0]), v))
    return rows + rows[:5] + [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(300)]


def best_products(rows, k=5):
    good = [(i, [math.floor(Fraction(c) * 256) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, x) in enumerate(good):
        if i % 50 == 0:
            scores = sorted((-max(-LONGEST, min(LONGEST, sum(p * q for p, q in zip(x, y, strict=True)))), j) for b, (j, y) in enumerate(good) if b != a and len(x) == len(y))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, block int, row int").repartition(5)
    want = best_products(rows)
    for sizes in ({}, {"shard_rows": 64, "block_rows": 16, "fan": 2}):
        assert sorted(tuple(r) for r in exact_top_k(df, **sizes).collect()) == want


def test_top_k_of_nothing_and_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert exact_top_k(spark.createDataFrame([], kind)).collect() == []
    assert exact_top_k(spark.createDataFrame([(0, None), (50, [math.nan])], kind)).collect() == []
    assert exact_top_k(spark.createDataFrame([(0, [1.0])], kind)).collect() == []
    got = exact_top_k(spark.createDataFrame([(0, [0.0, 0.0]), (7, [1.0, -1.0]), (3, [-0.001, 0.0])], kind)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 3, 0), (0, 2, 7, 0)]


def sha(joined):
    return hashlib.sha256(joined.encode()).hexdigest()


def whole_manifest(rows):
    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def lowered(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def tree(digests):
        paths, at = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, place in enumerate(at):
                begin = place // 16 * 16
                paths[i].append(("".join(digests[begin:place]), "".join(digests[place + 1:begin + 16])))
                at[i] //= 16
            digests = [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)]
        return digests[0], paths

    by_source = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by_source.setdefault(r[1], []).append((r[0], leaf(r), leaf((*r[:4], lowered(r[4]))) if changed else leaf(r)))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree([r[1] for r in by_source[s]]))
    root, tops = tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for (i, own, f), path in zip(by_source[s], paths, strict=True):
            for left, right in path + top:
                f = sha(left + f + right)
            out.append((i, own, subroot, root, sha("".join(a + b for a, b in path + top)), f, f == root))
    return sorted(out, key=text_key)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice([i] * 9 + [None, 7]), rng.choice(["a"] * 6 + ["b", "é", "z", None] + [f"s{rng.randrange(60)}"] * 2), rng.choice(["en", None]), rng.choice([3, None]),
             rng.choice([None, "", "Ab c Ü", "XYZ" * rng.randrange(2000), f"t{i}"])) for i in range(1500)]
    rows += rows[:40]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree long, pos long, n long").repartition(6)
    want = whole_manifest(rows)
    assert any(not r[-1] for r in want)
    # Superblocks of 16^3 leaves hold a whole tree here; of 16, trees take several tiers.
    for levels in (3, 1):
        assert sorted((tuple(r) for r in tampered_manifest(df, levels=levels).collect()), key=text_key) == want


def test_manifest_of_nothing_and_of_one(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert tampered_manifest(spark.createDataFrame([], kind)).collect() == []
    row = (None, None, None, None, None)
    got = [tuple(r) for r in tampered_manifest(spark.createDataFrame([row], kind)).collect()]
    assert got == [(None, sha("-----"), sha("-----"), sha("-----"), sha(""), sha("-----"), True)]


def whole_trie(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append(((t is not None, t or 0, r, hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest()), (r, x)))
    own = {c: [turn for _, turn in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    whole, members, children = {}, {}, {}
    for c in own:
        head, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = own.get(base, [])[:head] + own[c][head:]
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    @functools.cache
    def below(node):
        own = (0 if node in children else 1, (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
        return tuple(map(sum, zip(own, *map(below, children.get(node, [])), strict=True)))

    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, [])), *below(n),
                    sha(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n)))))) for n, m in members.items()), key=text_key)


def talks(seed):
    """Shared beginnings, whole copies, gaps in ids, negative ids, null and repeated turns, null and empty texts, one long conversation."""
    rng, rows = random.Random(seed), []
    for c in [*rng.sample(range(-40, 300), 200), None]:
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, rng.choice([t] * 8 + [None, 3]), rng.choice(["user", "a", None, ""]) if seed == 1 else "u", rng.choice(["x", "yé", "zz", None, ""][:2 if seed == 2 else 5])))
    rows += [(c, t, "u", "same") for c in range(1000, 1100) for t in range(c % 4)]
    return rows + [(5000 + k, t, "u", "x") for k in (0, 5) for t in range(300)] + rows[:9]


def test_trie_equals_brute_force(spark):
    for seed in (1, 2):
        rows = talks(seed)
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, one int").repartition(6)
        want = whole_trie(rows)
        # A small sketch is worked through in passes, and takes many prefixes for shared.
        for cells in (1 << 20, 1 << 13):
            assert sorted((tuple(r) for r in prefix_trie(df, most_cells=cells).collect()), key=text_key) == want


def test_trie_of_nothing_and_of_turnless(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert prefix_trie(spark.createDataFrame([], kind)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], kind)).collect() == []
    # crc32 of 3 leaves more than one own turn out, and its base is not there.
    assert zlib.crc32(b"3") % 9 > 1
    got = [tuple(r) for r in prefix_trie(spark.createDataFrame([(3, None, None, None)], kind)).collect()]
    assert got == [(3, 0, None, 1, 0, 1, 0, sha("3"))]
