"""SQL for the registered queries, in the words of a second engine.

Fragments are named common table expressions; :func:`q` puts those that a query needs
before its last SELECT, in order.
"""

from __future__ import annotations

K, CHUNK, VCHUNK = 10, 256, 64

WORDS = "regexp_split_to_array(lower({}), '[^a-z0-9]+')"
W32 = "CAST(ln(CAST(1 + {} AS DOUBLE)) AS FLOAT)"

PARTS = {
    # texts
    "dt": f"SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents",
    "dc": "SELECT doc_id, term, count(*) AS tf FROM dt WHERE term <> '' GROUP BY ALL",
    "p": f"SELECT doc_id, term, {W32.format('tf')} AS weight FROM dc",
    "qtok": f"SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark",
    "q": f"SELECT query_id, term, {W32.format('count(*)')} AS weight FROM qtok WHERE term <> '' GROUP BY query_id, term",
    "s": "SELECT query_id, doc_id, score FROM (SELECT q.query_id, p.doc_id, round(sum(q.weight * p.weight), 6) AS score FROM q JOIN p USING (term) GROUP BY ALL) WHERE score <> 0",
    "run": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM s) WHERE rank <= {K}",
    "run100": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM s) WHERE rank <= 100",
    "ts": "SELECT term, count(*) AS length, CAST(ceil(count(*) / 32) * 32 AS BIGINT) AS padded, max(weight) AS max_weight FROM p GROUP BY term",
    "rel": "SELECT b.item_id AS query_id, d.doc_id, CAST(1 + coalesce(l.quality, 0) AS BIGINT) AS relevance FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id",
    # vectors
    "vx": "SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS term FROM embeddings",
    "vp": f"SELECT vec_id AS doc_id, CAST(term AS INTEGER) AS term, CAST(ln(CAST(1 AS DOUBLE) + CAST(x AS DOUBLE)) AS FLOAT) AS weight FROM vx WHERE x > 0",
    "vq": "SELECT doc_id AS query_id, term, weight FROM vp",
    "vs": "SELECT query_id, doc_id, score FROM (SELECT vq.query_id, vp.doc_id, round(sum(vq.weight * vp.weight), 6) AS score FROM vq JOIN vp USING (term) GROUP BY ALL) WHERE score <> 0",
    "vrun": f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM vs) WHERE rank <= {K}",
    "vrel": "SELECT a.vec_id AS query_id, b.vec_id AS doc_id, CAST(1 AS BIGINT) AS relevance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id",
    # purchases and events
    "lp": "SELECT l_orderkey AS doc_id, l_partkey AS term, CAST(l_quantity AS FLOAT) AS weight FROM lineitem",
    "ep": "SELECT user_id AS doc_id, event_type AS term, CAST(count(*) AS FLOAT) AS weight FROM events GROUP BY ALL",
    "eq": "SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS query_id, event_type AS term, CAST(count(*) AS FLOAT) AS weight FROM events GROUP BY ALL",
}

TEXT = ("dt", "dc", "p", "qtok", "q", "s", "run")
VECTOR = ("vx", "vp", "vq", "vs", "vrun")


def q(names, last: str, **more: str) -> str:
    parts = [f"{n} AS ({PARTS[n]})" for n in names] + [f"{n} AS ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {last}" if parts else last


def top(source: str, k: int = K) -> str:
    return f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS BIGINT) AS rank FROM {source}) WHERE rank <= {k}"


def scored(queries: str, postings: str) -> str:
    return f"SELECT query_id, doc_id, score FROM (SELECT a.query_id, b.doc_id, round(sum(a.weight * b.weight), 6) AS score FROM {queries} a JOIN {postings} b USING (term) GROUP BY ALL) WHERE score <> 0"


RUN_COLUMNS = "query_id, doc_id, score, rank"


def mean_metric(value: str, per: str, every: str) -> str:
    return f"SELECT round(avg(coalesce({value}, 0)), 6) AS {value}, count(*) AS n_queries FROM ({every}) LEFT JOIN ({per}) USING (query_id)"


def ndcg_sql(run: str, rel: str, k: int, gain: str) -> str:
    g = "relevance" if gain == "linear" else "(pow(CAST(2 AS DOUBLE), relevance) - 1)"
    dcg = f"SELECT query_id, sum({g} / log2(CAST(rank AS DOUBLE) + 1)) AS dcg FROM {run} JOIN {rel} USING (query_id, doc_id) WHERE rank <= {k} AND relevance > 0 GROUP BY query_id"
    ideal = f"SELECT query_id, sum({g} / log2(CAST(place AS DOUBLE) + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, doc_id) AS place FROM {rel} WHERE relevance > 0) WHERE place <= {k} GROUP BY query_id"
    return f"SELECT query_id, coalesce(dcg, 0) / ideal AS ndcg FROM ({ideal}) LEFT JOIN ({dcg}) USING (query_id)"


def mrr_sql(run: str, rel: str, k: int) -> str:
    return f"SELECT query_id, CAST(1 AS DOUBLE) / min(rank) AS mrr FROM {run} JOIN {rel} USING (query_id, doc_id) WHERE rank <= {k} AND relevance > 0 GROUP BY query_id"


def recall_sql(run: str, rel: str, k: int) -> str:
    n = f"SELECT query_id, count(DISTINCT doc_id) AS n FROM {rel} WHERE relevance > 0 GROUP BY query_id"
    m = f"SELECT query_id, count(DISTINCT doc_id) AS m FROM {run} JOIN {rel} USING (query_id, doc_id) WHERE rank <= {k} AND relevance > 0 GROUP BY query_id"
    return f"SELECT query_id, CAST(coalesce(m, 0) AS DOUBLE) / n AS recall FROM ({n}) LEFT JOIN ({m}) USING (query_id)"


JUDGED = "SELECT DISTINCT query_id FROM {} WHERE relevance > 0"
