"""The registered queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from albumforge.llm.common import table
from albumforge.llm.language import held_out_language
from albumforge.llm.license_scan import PHRASES, TEMPLATES, license_scan
from albumforge.llm.merkle import tampered_manifest
from albumforge.llm.mixing import mix
from albumforge.llm.ngram_join import ngram_jaccard_join
from albumforge.llm.packing import best_fit_packing
from albumforge.llm.prefix_trie import prefix_trie
from albumforge.llm.quality_rules import quality_rules
from albumforge.llm.quality_votes import held_out_quality
from albumforge.llm.tiled_topk import exact_top_k
from albumforge.llm.token_files import read_digests, write_token_files
from albumforge.llm.toxicity import held_out_toxicity
from albumforge.llm.vantage import nearest

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@_register
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@_register
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (mixed["size"] * mixed["copies"]).alias("taken"))


@_register
def op10_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@_register
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), None, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_digests(files)


@_register
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)


@_register
def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


@_register
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_language(table(spark, sf_dir, "documents"))


@_register
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_register
def op11_tiled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


@_register
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


@_register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op1_ngram_jaccard"] = rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, sides.y FROM reached JOIN sides ON sides.x = reached.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.least AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS least FROM reached GROUP BY 1) m ON m.doc_id = d.doc_id"""

_SPLIT = r"list_filter(regexp_split_to_array({x}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '')"


def _at(phrase: str) -> str:
    test = " AND ".join(f"w[i + {k}] = '{word}'" for k, word in enumerate(phrase.split()))
    return f"list_filter(range(1, len(w) + 1), lambda i: {test})"


_ROWS = ", ".join(f"({i}, '{t.label}', {t.words}, {t.required.split()}, {t.span}, {-(-4 * len(t.words) // 5)})" for i, t in enumerate(TEMPLATES))
ORACLES["op9_license_scan"] = f"""WITH
t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
w AS (SELECT rid, doc_id, {_SPLIT.format(x="x")} AS w FROM t),
a AS (SELECT rid, doc_id, len(w) AS n_words, {", ".join(f"{_at(phrase)} AS p{i}" for i, (phrase, _) in enumerate(PHRASES))} FROM w),
b AS (SELECT *, list_concat(p0, list_concat(p1, p2)) AS every,
             list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, (_, label) in enumerate(PHRASES))}], lambda v: v IS NOT NULL) AS base FROM a),
v(no, label, words, required, span, need) AS (VALUES {_ROWS}),
o AS (SELECT w.rid, w.w, v.* FROM w JOIN v ON list_has_all(w.w, v.required)),
s AS (SELECT rid, label, words, required, need, unnest(list_transform(range(1, greatest(1, len(w) - span + 1) + 1), lambda i: w[i:i + span - 1])) AS block FROM o),
f AS (SELECT rid, label, len(list_distinct(list_intersect(block, words))) / len(words) AS containment FROM s
      WHERE list_has_all(block, required) AND len(list_distinct(list_intersect(block, words))) >= need),
m AS (SELECT rid, list(DISTINCT label) AS more, max(containment) AS containment FROM f GROUP BY 1)
SELECT doc_id, n_words, len(every) AS n_base, list_min(every) - 1 AS first_word, list_max(every) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0)::DOUBLE END AS score
FROM b LEFT JOIN m ON m.rid = b.rid"""

ORACLES["op10_vantage_search"] = """WITH
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM g q JOIN g c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES["op11_tiled_topk"] = """WITH
v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT r, vec_id, list_transform(x, lambda c: floor(256 * c)) AS x FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM g q JOIN g c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.x) = len(q.x)),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM n WHERE rank <= 5"""

#: crc32 of a number's decimal digits: the table by its rule, then digit by digit.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS steps FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""


def _crc(number: str) -> str:
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))"
    return f"xor(list_reduce({digits}, lambda c, b: xor(c >> 8, crc.steps[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _leaf(text: str) -> str:
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"


def _levels(name: str, tree: str, count: int) -> str:
    """n{k}: the nodes of level k (tree, pos, h, n of the level); p{k}: the joined siblings of each node on its way up, left and right."""
    out = []
    for k in range(count):
        own, up = f"{name}{k}", f"{name}{k + 1}"
        out.append(f"""{name}r{k} AS (SELECT {tree}, pos // 16 AS pos, string_agg(h, '' ORDER BY pos) AS h, min(n) AS n FROM {own} GROUP BY {tree}, pos // 16),
{up} AS (SELECT {tree}, pos, CASE WHEN n > 1 THEN sha256(h) ELSE h END AS h, (n + 15) // 16 AS n FROM {name}r{k}),
{name}s{k} AS (SELECT a.{tree}, a.pos, CASE WHEN a.n > 1 THEN substr(r.h, 1, 64 * CAST(a.pos % 16 AS INT)) ELSE '' END AS l,
  CASE WHEN a.n > 1 THEN substr(r.h, 64 * CAST(a.pos % 16 AS INT) + 65) ELSE '' END AS r, a.n > 1 AS folds FROM {own} a JOIN {name}r{k} r ON r.{tree} = a.{tree} AND r.pos = a.pos // 16)""")
    return ",\n".join(out)


def _folded(names: list[str]) -> str:
    """The digest f taken up through the named levels, and the siblings met."""
    steps, before = [], "up0"
    for i, (name, place) in enumerate(names):
        steps.append(f"""up{i + 1} AS (SELECT u.* REPLACE (CASE WHEN s.folds THEN sha256(s.l || u.f || s.r) ELSE u.f END AS f, u.met || s.l || s.r AS met)
  FROM {before} u JOIN {name} s ON {place})""")
        before = f"up{i + 1}"
    return ",\n".join(steps)


# Six levels of 16: more rows than any table that SQL is run on here.
_DEPTH = 6
ORACLES["op12_merkle_manifest"] = f"""WITH {_CRC_TABLE},
d AS (SELECT *, translate(text, '{_UPPER}', '{_LOWER}') AS low FROM documents),
h AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc("doc_id")} % 5 = 0 THEN {_leaf("low")} ELSE {_leaf("text")} END AS f FROM d, crc),
t AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM h GROUP BY source),
l AS (SELECT h.*, t.tree, t.n, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h JOIN t ON t.source IS NOT DISTINCT FROM h.source),
a0 AS (SELECT tree, pos, leaf AS h, n FROM l),
{_levels("a", "tree", _DEPTH)},
b0 AS (SELECT 0 AS one, tree AS pos, h, (SELECT count(*) FROM t) AS n FROM a{_DEPTH}),
{_levels("b", "one", _DEPTH)},
up0 AS (SELECT doc_id, leaf, tree, pos, f, '' AS met FROM l),
{_folded([(f"as{k}", f"s.tree = u.tree AND s.pos = u.pos // {16**k}") for k in range(_DEPTH)] + [(f"bs{k}", f"s.pos = u.tree // {16**k}") for k in range(_DEPTH)])}
SELECT u.doc_id, u.leaf, a.h AS subroot, b.h AS root, sha256(u.met) AS proof_sha256, u.f AS folded_root, u.f = b.h AS verified
FROM up{2 * _DEPTH} u JOIN a{_DEPTH} a ON a.tree = u.tree CROSS JOIN b{_DEPTH} b"""

ORACLES["op13_prefix_trie"] = f"""WITH {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT *, md5(strlen(role) || ':' || role || text) AS said FROM o),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS place FROM m),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc("conv_id")} % 9 AS head FROM (SELECT DISTINCT conv_id FROM o), crc),
r AS (SELECT c.conv_id, 0 AS half, p.place, p.role, p.text FROM c JOIN p ON p.conv_id = c.base AND p.place < c.head
      UNION ALL SELECT c.conv_id, 1, p.place, p.role, p.text FROM c JOIN p ON p.conv_id = c.conv_id AND p.place >= c.head),
s AS (SELECT conv_id, strlen(text) AS bytes, sha256(strlen(role) || ':' || role || text) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY half, place) AS depth FROM r),
q AS (SELECT c.conv_id, coalesce(max(depth), 0) AS length FROM c LEFT JOIN s ON s.conv_id = c.conv_id GROUP BY 1),
k AS (SELECT conv_id, depth, bytes, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT path, min(depth) AS depth, min(bytes) AS bytes, min(k.conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(CASE WHEN length = depth THEN k.conv_id END, ',' ORDER BY k.conv_id), '') AS ended
      FROM k JOIN q ON q.conv_id = k.conv_id GROUP BY path),
u AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n up ON n.depth > 0 AND up.path = left(n.path, length(n.path) - 64)),
f AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
x AS (SELECT DISTINCT hi.path AS top, lo.path AS path FROM k hi JOIN k lo ON lo.conv_id = hi.conv_id AND lo.depth >= hi.depth),
t AS (SELECT x.top, sum(CASE WHEN f.path IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
      FROM x JOIN n ON n.path = x.path LEFT JOIN f ON f.path = x.path GROUP BY 1)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, u.parent_conv_id, u.n_convs, coalesce(f.n_children, 0) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(u.ended) AS ends_sha256
FROM u LEFT JOIN f ON f.path = u.path JOIN t ON t.top = u.path"""
