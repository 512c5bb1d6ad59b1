"""The numbered queries: each applies one operator, with production
parameters, to its whole table."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import utc
from .common import fold_of, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        utc(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


@_query
def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    from .mips import top_k

    e = read_table(spark, sf_dir, "embeddings")
    return top_k(e, e.filter(F.col("vec_id") % 50 == 0), 5)


SQL["op2_exact_topk"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM c q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


#: (verdict, host and path) of the URL list.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the URL rules on every page."""
    from .url_rules import apply_url_rules, parse_rule

    return apply_url_rules(spark, read_table(spark, sf_dir, "pages"), [parse_rule(*r) for r in URL_RULES])


SQL["op9_url_filter"] = """
WITH a AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*', 0) AS hp FROM a),
c AS (SELECT page_id, translate(regexp_extract(hp, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(hp, length(regexp_extract(hp, '^[^/]*', 0)) + 1) AS path FROM b),
r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                            ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
  FROM c JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p) GROUP BY 1)
SELECT c.page_id, c.host, c.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)"""


@_query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .html_text import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 4096 tokens."""
    import public_tokenizers

    from .packing import Capacity, best_fit, token_pieces

    cap = Capacity()
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), max_tokens=cap.tokens)
    return best_fit(pieces, cap)


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _labelled(spark: SparkSession, sf_dir: str, docs: DataFrame, label: str) -> DataFrame:
    """doc_id, text and one label of the documents that have it.  The labels
    are one narrow row per labelled document; Spark picks the join."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", label).filter(F.col(label).isNotNull())
    return docs.select("doc_id", "text").join(labels, "doc_id")


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled rows outside fold 2
    of 4.  A row without an id has no fold: it is scored, not learned from, and its held_out is null."""
    from . import toxicity

    docs = read_table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 4) == 2
    model = toxicity.fit(_labelled(spark, sf_dir, docs, "toxic").filter(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned outside fold 0 of 5.  A row without
    an id has no fold: it is predicted, not learned from, and its held_out is null."""
    from . import language_id

    docs = read_table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 5) == 0
    net = language_id.fit(docs.filter(~held))
    return language_id.predict(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labelled rows outside fold 0
    of 5.  A row without an id has no fold: it is scored, not learned from, and its held_out is null."""
    from . import quality_cnn

    docs = read_table(spark, sf_dir, "documents")
    held = fold_of(F.col("doc_id"), 5) == 0
    net = quality_cnn.fit(_labelled(spark, sf_dir, docs, "quality").filter(~held))
    return quality_cnn.score(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")


@_query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    from .near_dup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in any document."""
    from .decontamination import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, and decoded from their ids."""
    import public_tokenizers

    from .bpe_stream import decode, encode

    path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(read_table(spark, sf_dir, "documents"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each language compared by their words, over all documents."""
    from .divergence import source_divergence

    return source_divergence(read_table(spark, sf_dir, "documents"))


SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (
  SELECT id, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS times FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*) AS v, sum(times) AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS times FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(times) AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.times, 0) AS times,
         CAST(1 + 1000000000::HUGEINT * (coalesce(c.times, 0) + 2) // (coalesce(n.n, 0) + 2 * l.v) AS BIGINT) AS p,
         CAST(1 + 1000000000::HUGEINT * (k.times + 2) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE times > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10"""


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt with their group's first turns."""
    from . import prefix_trie as trie
    from .common import written

    own = written(trie.turns(read_table(spark, sf_dir, "conversations")), "trie-turns")
    return trie.prefix_trie(trie.sequences(trie.with_shared_heads(own), own.select("conv_id").distinct()))


SQL["op12_prefix_trie"] = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce([4294967295] || [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
                         lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o), tab),
r AS (
  SELECT h.conv_id, o.place, o.role, o.text FROM h JOIN o ON o.conv_id = h.base AND o.place <= h.h
  UNION ALL SELECT h.conv_id, o.place, o.role, o.text FROM h JOIN o ON o.conv_id = h.conv_id AND o.place > h.h),
s AS (SELECT h.conv_id, coalesce(list({'r': role, 't': text} ORDER BY place) FILTER (place IS NOT NULL), []) AS seq FROM h LEFT JOIN r USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s),
node AS (
  SELECT seq[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = len(seq)), '') AS ids,
         CASE WHEN depth = 0 THEN 0 ELSE length(any_value(seq[depth].t)) END AS size
  FROM p GROUP BY 1, 2),
child AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (prefix)),
up AS (SELECT *, unnest(range(0, depth + 1)) AS top FROM full_node),
sub AS (
  SELECT prefix[1:top] AS prefix, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM up GROUP BY 1)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, sub.n_leaves,
       CAST(sub.saved_tokens AS BIGINT) AS saved_tokens, sha256(a.ids) AS ends_sha256
FROM full_node a JOIN sub ON sub.prefix = a.prefix LEFT JOIN full_node b ON a.depth > 0 AND b.prefix = a.prefix[1:a.depth - 1]"""
