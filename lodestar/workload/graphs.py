"""Knowledge graph over the star schema: customers and suppliers in nations, nations in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import norm_predicate, strip
from ..functions.triplet_parser import parsed, register_triplet_parser
from ..operators import collections as C
from ..operators import communities as M
from ..operators import embedding as D
from ..operators import graph as G
from ..operators import modularity as Q
from ..session import durable
from .base import query
from .ranking import lower_words
from .vectors import DIM, sql_embed, sql_rank


def _relation(subject: str, name: str):
    """A relation's name as a value of the row. As a bare literal it would fold joins on it into conditions without keys."""
    return F.when(F.col(subject).isNotNull(), name).alias("predicate")


def triplets(t) -> DataFrame:
    """(subject, predicate, object, description, document_id). Descriptions repeat or are blank on purpose."""
    nation, region = t("nation"), t("region")
    customers = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("subject"), _relation("c_name", "in_nation"), F.col("n_name").alias("object"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(
            F.concat("c_mktsegment", F.lit(" customers of "), "n_name")
        ).alias("description"),
        F.col("c_mktsegment").alias("document_id"),
    )
    suppliers = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("subject"), _relation("s_name", "in_nation"), F.col("n_name").alias("object"),
        F.lit("").alias("description"), F.lit("suppliers").alias("document_id"),
    )
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("subject"), _relation("n_name", "in_region"), F.col("r_name").alias("object"),
        F.concat("n_name", F.lit(" lies in "), "r_name").alias("description"), F.lit("geography").alias("document_id"),
    )
    return customers.unionByName(suppliers).unionByName(nations)


SQL_T = """
  SELECT c_name AS subject, 'in_nation' AS predicate, n_name AS object,
         CASE WHEN c_mktsegment='BUILDING' THEN '' ELSE c_mktsegment||' customers of '||n_name END AS description, c_mktsegment AS document_id
  FROM customer JOIN nation ON c_nationkey=n_nationkey
  UNION ALL SELECT s_name, 'in_nation', n_name, '', 'suppliers' FROM supplier JOIN nation ON s_nationkey=n_nationkey
  UNION ALL SELECT n_name, 'in_region', r_name, n_name||' lies in '||r_name, 'geography' FROM nation JOIN region ON n_regionkey=r_regionkey"""
SQL_NAMES = f"SELECT subject AS name FROM ({SQL_T}) UNION SELECT object FROM ({SQL_T})"

query("a12_graph_entities", SQL_NAMES)(lambda t: C.build_graph(triplets(t))[0])
query("a12_graph_edges", f"SELECT DISTINCT subject, predicate, object, description FROM ({SQL_T})")(
    lambda t: C.build_graph(triplets(t).unionByName(triplets(t)))[1]
)
query("a12_graph_provenance", f"""
  SELECT subject AS name, document_id FROM ({SQL_T}) UNION SELECT object, document_id FROM ({SQL_T})""")(
    lambda t: C.build_graph(triplets(t))[2]
)


def _offered(t) -> DataFrame:
    """Vectors for all entities: regions come without a vector, suppliers without a name."""
    names = D.entity_vectors(triplets(t), DIM)
    is_region = F.contains("name", F.lit("#")) | F.startswith("name", F.lit("NATION"))
    blanked = F.when(F.startswith("name", F.lit("Supplier")), F.lit("")).otherwise(F.col("name"))
    return names.select(blanked.alias("name"), F.when(is_region, F.col("embedding")).alias("embedding"))


query("a13_attach_counts", f"""
  SELECT count(*) AS offered, count(*) FILTER (bad) AS skipped, count(*) FILTER (NOT bad AND is_customer) AS updated,
         count(*) FILTER (NOT bad AND NOT is_customer) AS unmatched FROM (
    SELECT starts_with(name,'Supplier') OR NOT (contains(name,'#') OR starts_with(name,'NATION')) AS bad, name IN (SELECT c_name FROM customer) AS is_customer
    FROM ({SQL_NAMES}))""")(lambda t: C.attach_counts(t("customer").select(F.col("c_name").alias("name")), _offered(t), ["name"]))
query("a13_attach_embeddings", f"""
  SELECT name, CAST(CASE WHEN starts_with(name,'Supplier') OR NOT (contains(name,'#') OR starts_with(name,'NATION')) THEN 0 ELSE 64 END AS INTEGER) AS dim
  FROM ({SQL_NAMES})""")(
    lambda t: C.attach_embeddings(D.entity_names(triplets(t)), _offered(t), ["name"]).select(
        "name", F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(0)).alias("dim")
    )
)
query("d05_entity_vectors", f"SELECT name, CAST(64 AS INTEGER) AS dim FROM ({SQL_NAMES})")(
    lambda t: D.entity_vectors(triplets(t), DIM).select("name", F.size("embedding").alias("dim"))
)
SQL_REL = f"""SELECT *, CASE WHEN description <> '' THEN description ELSE subject||' '||predicate||' '||object END AS rel_text,
  subject||'|'||predicate||'|'||object AS rel_key FROM ({SQL_T})"""
query("d06_relationship_texts", f"SELECT rel_key, rel_text, document_id FROM ({SQL_REL})")(
    lambda t: D.relationship_texts(triplets(t)).select("rel_key", "rel_text", "document_id")
)

# Responses with good lines, lines that break each rule, and quoted fields.


def responses(t) -> DataFrame:
    s = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(
        F.lit("Here are the triplets:\n("), "s_name", F.lit(", Has Base In, "), "n_name", F.lit(", A supplier of "), "n_name", F.lit(") as asked\n("),
        "s_name", F.lit(", has base in)\n)late( bracket\n(\""), "n_name", F.lit("\", hosts, \""), "s_name", F.lit("\", home, and more (or less))\n("),
        "n_name", F.lit(", , "), "s_name", F.lit(", no relation)\n(x, y, "), F.repeat(F.col("s_name"), 8), F.lit(", too long)\n"),
    )
    return s.select("s_suppkey", text.alias("response"), F.when(F.col("n_regionkey") == 0, "tiny").otherwise("a text that is long enough").alias("source_text"))


SQL_RESPONSES = """SELECT s_suppkey, 'Here are the triplets:'||chr(10)||'('||s_name||', Has Base In, '||n_name||', A supplier of '||n_name||') as asked'||chr(10)||'('||
    s_name||', has base in)'||chr(10)||')late( bracket'||chr(10)||'("'||n_name||'", hosts, "'||s_name||'", home, and more (or less))'||chr(10)||'('||
    n_name||', , '||s_name||', no relation)'||chr(10)||'(x, y, '||repeat(s_name,8)||', too long)'||chr(10) AS response
  FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE n_regionkey <> 0"""


def sql_triplets(mode: str) -> str:
    close = "strpos(line,')')" if mode == "strict" else "length(line)-strpos(reverse(line),')')+1"
    fields = "string_split(body, ',')"
    if mode == "lenient":
        fields = f"CASE WHEN len({fields}) > 4 THEN list_append({fields}[1:3], array_to_string({fields}[4:], ',')) ELSE {fields} END"
    cap = "list_transform(f, lambda x: regexp_replace(trim(x), '^\"+|\"+$', '', 'g'))"
    return f"""
      SELECT s_suppkey AS doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, c[1] AS subject, replace(lower(strip_accents(c[2])),' ','_') AS predicate, c[3] AS object, c[4] AS description FROM (
        SELECT s_suppkey, line_no, list_transform({cap}, lambda x: upper(substr(x,1,1))||lower(substr(x,2))) AS c, f FROM (
          SELECT s_suppkey, line_no, {fields} AS f FROM (
            SELECT s_suppkey, line_no, substr(line, strpos(line,'(')+1, {close}-strpos(line,'(')-1) AS body FROM (
              SELECT s_suppkey, unnest(string_split(response, chr(10))) AS line, unnest(range(1, len(string_split(response, chr(10)))+1)) AS line_no FROM ({SQL_RESPONSES}))
            WHERE contains(line,'(') AND contains(line,')') AND {close} > strpos(line,'(')))
        WHERE len(f)=4 AND len(list_filter(f, lambda x: strlen(x) > 128))=0 AND trim(f[1])<>'' AND trim(f[2])<>'' AND trim(f[3])<>'')"""


for _mode in ("strict", "lenient"):
    query(f"h01_parse_triplets_{_mode}", sql_triplets(_mode))(
        lambda t, m=_mode: G.parse_triplets(responses(t), "s_suppkey", "response", m, "source_text")
    )



@query("n_triplet_column", sql_triplets("strict"))
def triplet_column(t) -> DataFrame:
    """The parser as a column of arrays."""
    usable = responses(t).where(F.length(strip(F.col("source_text"))) >= G.MIN_TEXT)
    found = usable.select(F.col("s_suppkey").alias("doc_id"), G.triplets_of(G.triplet_fields(F.col("response"))).alias("found"))
    return found.select("doc_id", F.inline("found"))


@query("n_triplet_function", sql_triplets("strict"))
def triplet_function(t) -> DataFrame:
    """A parser of the user's own as a table function in SQL."""
    responses(t).where(F.length(strip(F.col("source_text"))) >= G.MIN_TEXT).createOrReplaceTempView("responses_to_parse")
    register_triplet_parser(t.spark, "bracketed_triplets")
    return parsed(t.spark, "bracketed_triplets", "responses_to_parse", "s_suppkey", "response")


query("h02_norm_predicate", """
  SELECT doc_id, replace(lower(strip_accents(replace(replace(replace(replace(w,'ß','ss'),'æ','ae'),'œ','oe'),'Œ','OE'))),' ','_') AS predicate
  FROM (SELECT doc_id, substr(text, 1, length(text)) AS w FROM documents)""")(
    lambda t: t("documents").select("doc_id", norm_predicate(F.col("text")).alias("predicate"))
)
query("h03_parse_arrow", f"""
  SELECT subject, predicate, object FROM ({SQL_T}) WHERE description <> ''""")(
    lambda t: triplets(t).select(
        F.when(F.col("description") != "", G.arrow_text(F.col("subject"), F.col("predicate"), F.col("object"))).otherwise("no arrow").alias("x")
    ).select(G.parse_arrow(F.col("x")).alias("p")).where("p is not null").select("p.*")
)


def graph_json(t) -> DataFrame:
    """A JSON answer per customer inside other words. BUILDING answers have an incomplete entity, FURNITURE ones are cut off."""
    segment = F.col("c_mktsegment")
    text = F.concat(
        F.lit('Result: {"entities":[{"entity_name":"'), "c_name", F.lit('","entity_type":"customer","entity_description":"'), segment, F.lit('"}'),
        F.when(segment == "BUILDING", ',{"entity_name":"half"}').otherwise(""),
        F.lit('],"relationships":[{"source_entity":"'), "c_name", F.lit('","target_entity":"'), segment,
        F.lit('","relation":"buys in","relationship_description":"line one\\nline two"}'),
        F.when(segment == "FURNITURE", "").otherwise("]} end of answer"),
    )
    return t("customer").select("c_custkey", text.alias("answer"))


query("h04_json_entities", """
  SELECT c_custkey AS doc_id, c_name AS entity_name, 'customer' AS entity_type, c_mktsegment AS entity_description FROM customer WHERE c_mktsegment <> 'FURNITURE'""")(
    lambda t: G.parse_graph_json(graph_json(t), "c_custkey", "answer")[0]
)
query("h04_json_relations", """
  SELECT c_custkey AS doc_id, c_name AS source_entity, c_mktsegment AS target_entity, 'buys in' AS relation, 'line one'||chr(10)||'line two' AS relationship_description
  FROM customer WHERE c_mktsegment <> 'FURNITURE'""")(lambda t: G.parse_graph_json(graph_json(t), "c_custkey", "answer")[1])
query("h04_json_quarantine", "SELECT c_custkey AS doc_id, 'entities' AS part FROM customer WHERE c_mktsegment = 'BUILDING'")(
    lambda t: G.parse_graph_json(graph_json(t), "c_custkey", "answer")[2]
)


def _loaded(t):
    return C.build_graph(triplets(t))


query("h05_query_graph", f"""
  SELECT DISTINCT e.subject, e.predicate, e.object, e.description, p.document_id FROM ({SQL_T}) e
  LEFT JOIN (SELECT subject AS name, document_id FROM ({SQL_T}) UNION SELECT object, document_id FROM ({SQL_T})) p ON p.name = e.subject
  WHERE contains(lower(e.object), 'nation_1') AND contains(lower(e.predicate), 'nation')""")(
    lambda t: G.query_graph(_loaded(t)[1], _loaded(t)[2], predicate="Nation", object="nation_1", limit=None)
)
query("h05_query_graph_limited", f"""
  SELECT DISTINCT subject, predicate, object, description FROM ({SQL_T}) ORDER BY ALL LIMIT 100""")(lambda t: G.query_graph(_loaded(t)[1], limit=100))


def nation_questions(t, *parts) -> DataFrame:
    joined = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = joined.select(F.col("n_nationkey").alias("query_id"), F.concat(*parts).alias("query_text"))
    return D.embed(asked, "query_text", DIM)


SQL_NATION_Q = "(SELECT n_nationkey, {x} AS q FROM nation JOIN region ON n_regionkey=r_regionkey)"
_EDGE_Q = SQL_NATION_Q.format(x="'MACHINERY customers of '||n_name")
query("h06_graph_vector_search", f"""
  SELECT query_id, id AS name, score, rank FROM ({sql_rank(f'''SELECT q.id AS query_id, d.id AS id, round(list_cosine_similarity(q.v, d.v),6) AS score
    FROM ({sql_embed(_EDGE_Q, 'n_nationkey', 'q')}) q,
    ({sql_embed(f"(SELECT DISTINCT rel_key, rel_text FROM ({SQL_REL}))", 'rel_key', 'rel_text')}) d
    WHERE round(list_cosine_similarity(q.v, d.v),6) >= 0.7''', 10)})""")(
    lambda t: G.graph_vector_search(
        nation_questions(t, F.lit("MACHINERY customers of "), "n_name"),
        D.embed(D.relationship_texts(triplets(t)).select(F.col("rel_key").alias("name"), "rel_text").distinct(), "rel_text", DIM),
    )
)


def region_seeds(t) -> DataFrame:
    return t("nation").select(F.col("n_regionkey").alias("query_id"), F.col("n_name").alias("name"))


def sql_expand(seeds: str, cut: str = "") -> str:
    key = "CASE WHEN description='' THEN 'spo|'||subject||'|'||predicate||'|'||object ELSE 'd|'||description END"
    return f"""
      SELECT * FROM (
        SELECT query_id, name AS seed_entity, subject, predicate, object, description, score, {key} AS k, side FROM (
          SELECT e.*, s.*, 0 AS side FROM (SELECT DISTINCT subject, predicate, object, description FROM ({SQL_T})) e JOIN ({seeds}) s ON s.name = e.subject
          UNION ALL SELECT e.*, s.*, 1 FROM (SELECT DISTINCT subject, predicate, object, description FROM ({SQL_T})) e JOIN ({seeds}) s ON s.name = e.object))
      QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY side, subject, predicate, object, seed_entity) = 1"""


SQL_SEEDS = "SELECT n_regionkey AS query_id, n_name AS name, 1.0::DOUBLE AS score FROM nation"
query("h07_expand_seeds", f"SELECT query_id, seed_entity, subject, predicate, object, description FROM ({sql_expand(SQL_SEEDS)})")(
    lambda t: G.expand_seeds(region_seeds(t), _loaded(t)[1]).drop("score")
)
query("h07_expand_seeds_limited", f"""
  SELECT query_id, seed_entity, subject, predicate, object, description, CAST(r AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seed_entity, subject, predicate, object, description) AS r
    FROM ({sql_expand(SQL_SEEDS)})) WHERE r <= 20""")(lambda t: G.expand_seeds(region_seeds(t), _loaded(t)[1], 20).drop("score"))


def _listed(t):
    entities = t("nation").where("n_regionkey = 1").select(F.col("n_name").alias("name")).unionByName(
        t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("name"))
    )
    relations = triplets(t).where(F.startswith("predicate", F.lit("in_n"))).select(F.col("predicate").alias("name"))
    return entities, relations


SQL_H8 = f"""
  WITH e AS (SELECT n_name AS name FROM nation WHERE n_regionkey=1 UNION SELECT c_name FROM customer WHERE c_mktsegment='BUILDING')
  SELECT DISTINCT subject, predicate, object, description,
    CASE WHEN subject IN (SELECT name FROM e) AND object IN (SELECT name FROM e) THEN 3.0 ELSE 2.0 END::DOUBLE AS relevance_score
  FROM ({SQL_T}) WHERE predicate='in_nation' AND (subject IN (SELECT name FROM e) OR object IN (SELECT name FROM e))"""
query("h08_entity_relationships", SQL_H8)(lambda t: G.query_entity_relationships(_loaded(t)[1], *_listed(t), limit=None))
query("h08_entity_relationships_limited", f"{SQL_H8} ORDER BY relevance_score DESC, subject, predicate, object, description LIMIT 20")(
    lambda t: G.query_entity_relationships(_loaded(t)[1], *_listed(t), limit=20)
)

_NAME_Q = SQL_NATION_Q.format(x="n_name||' '||r_name")
SQL_NEAR = f"""SELECT query_id, id AS name, score FROM ({sql_rank(f'''SELECT q.id AS query_id, d.id AS id, round(list_cosine_similarity(q.v, d.v),6) AS score
    FROM ({sql_embed(_NAME_Q, 'n_nationkey', 'q')}) q, ({sql_embed(f"({SQL_NAMES})", 'name', 'name')}) d
    WHERE round(list_cosine_similarity(q.v, d.v),6) >= 0.7''', 5)})"""
SQL_RETRIEVED = f"""
  SELECT query_id, md5(subject||'|'||predicate||'|'||object||'|'||description) AS id,
    CASE WHEN description <> '' THEN description ELSE subject||' '||predicate||' '||object END AS content,
    '('||subject||') --['||predicate||']--> ('||object||')' AS triplet, score, CAST(r AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seed_entity, subject, predicate, object, description) AS r
    FROM ({sql_expand(SQL_NEAR)})) WHERE r <= 10"""


def retrieved(t) -> DataFrame:
    entities = D.entity_vectors(triplets(t), DIM)
    return G.graph_retrieve(nation_questions(t, "n_name", F.lit(" "), "r_name"), entities, _loaded(t)[1], 5)


query("h09_graph_retrieve", SQL_RETRIEVED)(retrieved)
query("h10_graph_rerank", f"""
  SELECT query_id, id, score, CAST(r AS INTEGER) AS rank, content, triplet FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (
      SELECT query_id, id, content, triplet, round(len(list_intersect(a,b))::DOUBLE/len(list_distinct(list_concat(a,b))),6) AS score FROM (
        SELECT h.*, list_distinct({lower_words('q')}) AS a, list_distinct({lower_words('content')}) AS b
        FROM ({SQL_RETRIEVED}) h JOIN {_NAME_Q} n ON n.n_nationkey = h.query_id))) WHERE r <= 3""")(
    lambda t: G.graph_rerank(retrieved(t), nation_questions(t, "n_name", F.lit(" "), "r_name"), "model", 3)
)

# Communities.

SQL_WAYS = f"(SELECT subject AS src, object AS dst FROM ({SQL_T}) UNION ALL SELECT object, subject FROM ({SQL_T}))"
query("h11_connected_components", f"""
  WITH RECURSIVE ways AS (SELECT DISTINCT src, dst FROM {SQL_WAYS}),
  reach AS (SELECT name, name AS root FROM ({SQL_NAMES}) UNION SELECT w.dst, r.root FROM reach r JOIN ways w ON w.src = r.name)
  SELECT name, min(root) AS component FROM reach GROUP BY 1""")(lambda t: M.connected_components(triplets(t)))


def sql_round(labels: str) -> str:
    return f"""SELECT dst AS name, arg_min(label, (-votes, label)) AS label FROM (
      SELECT dst, label, count(*) AS votes FROM {SQL_WAYS} w JOIN {labels} l ON l.name = w.src GROUP BY ALL) GROUP BY 1"""


query("h11_label_propagation", f"""
  WITH l0 AS (SELECT name, name AS label FROM ({SQL_NAMES})), l1 AS ({sql_round('l0')}), l2 AS ({sql_round('l1')}), l3 AS ({sql_round('l2')})
  SELECT name, label FROM l3""")(lambda t: M.label_propagation(triplets(t), 3))


@query("h11_communities")
def capped(t):
    """As many rounds as it takes, so there is no SQL counterpart; the fixed point and the cover are tested."""
    return M.communities(triplets(t), 5, 2)


def by_nation(t) -> DataFrame:
    """(name, community_id): customers and suppliers belong to their nation's community, regions are one each."""
    every = triplets(t)
    local = F.col("predicate") == "in_nation"
    members = every.where(local).select(F.col("subject").alias("name"), F.col("object").alias("community_id"))
    hubs = every.select(F.explode(F.when(local, F.array("object")).otherwise(F.array("subject", "object"))).alias("name"))
    return members.unionByName(hubs.select("name", F.col("name").alias("community_id"))).distinct()


SQL_MEMBERS = f"""(SELECT subject AS name, object AS community_id FROM ({SQL_T}) WHERE predicate='in_nation'
  UNION SELECT object, object FROM ({SQL_T}) UNION SELECT subject, subject FROM ({SQL_T}) WHERE predicate='in_region')"""


def sql_modularity(members: str) -> str:
    """Modularity of a table of (name, c), the number of communities and the size of the largest."""
    return f"""SELECT round(sum(inner_) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) AS modularity, count(*) AS n_communities, max(n) AS largest FROM (
      SELECT m.c AS c, count(DISTINCT m.name) AS n, count(*)::DOUBLE AS total, count(*) FILTER (m.c = o.c)::DOUBLE AS inner_
      FROM {SQL_WAYS} w JOIN {members} m ON m.name = w.src JOIN {members} o ON o.name = w.dst GROUP BY m.c)"""


query("h11_modularity", sql_modularity(f"(SELECT name, community_id AS c FROM {SQL_MEMBERS})"))(
    lambda t: Q.modularity(Q.weighted_ways(triplets(t)), by_nation(t))
)


@query("h11_modular_communities")
def modular(t):
    """Seeded rounds without a SQL counterpart; ``h11_modular_gain`` compares what they reach."""
    return Q.modular_communities(triplets(t), 5)


@query("h11_modular_gain", f"""
  WITH l0 AS (SELECT name, name AS label FROM ({SQL_NAMES})), l1 AS ({sql_round('l0')}), l2 AS ({sql_round('l1')}), l3 AS MATERIALIZED ({sql_round('l2')}),
  p AS (SELECT modularity FROM ({sql_modularity('(SELECT name, label AS c FROM l3)')}))
  SELECT (SELECT count(*) FROM ({SQL_NAMES})) AS names, modularity AS propagated, true AS gains FROM p""")
def modular_gain(t):
    """Every name has a community, of a modularity no lower than that of propagated labels."""
    edges = triplets(t)
    ways = Q.weighted_ways(edges)
    found = durable(Q.modular_communities(edges).select("name", "community_id"))
    labels = M.label_propagation(edges, 3).select("name", F.col("label").alias("community_id"))
    reached = Q.modularity(ways, found).first()["modularity"]
    propagated = Q.modularity(ways, labels).select(F.col("modularity").alias("propagated"), (F.lit(reached) >= F.col("modularity")).alias("gains"))
    return propagated.select(F.lit(found.count()).cast("bigint").alias("names"), "propagated", "gains")

SQL_DETAILS = f"""SELECT DISTINCT community_id, m.name, neighbour, m.name||' -> '||neighbour||' -> '||predicate||' -> '||description AS detail FROM (
  SELECT subject AS name, object AS neighbour, predicate, description FROM ({SQL_T}) UNION ALL SELECT object, subject, predicate, description FROM ({SQL_T})) e
  JOIN {SQL_MEMBERS} m ON m.name = e.name"""
SQL_SUMMARY = f"""SELECT community_id, string_agg(detail, chr(10) ORDER BY r) || '.' AS summary FROM (
  SELECT community_id, detail, row_number() OVER (PARTITION BY community_id ORDER BY a.degree + b.degree DESC, detail) AS r FROM ({SQL_DETAILS}) d
  JOIN (SELECT src, count(*) AS degree FROM {SQL_WAYS} GROUP BY 1) a ON a.src = d.name
  JOIN (SELECT src, count(*) AS degree FROM {SQL_WAYS} GROUP BY 1) b ON b.src = d.neighbour) WHERE r <= 3 GROUP BY 1"""

query("h12_community_details", f"SELECT community_id, detail FROM ({SQL_DETAILS})")(
    lambda t: M.community_details(by_nation(t), triplets(t)).select("community_id", "detail")
)


def summaries(t) -> DataFrame:
    return M.summarise_communities(M.community_details(by_nation(t), triplets(t)), triplets(t), 3)


query("h13_community_summaries", SQL_SUMMARY)(summaries)


def relation_notes(t) -> DataFrame:
    """Notes with one relation per line; some lines do not have the form."""
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(
        F.lit("Notes:\nSupplier "), F.col("s_suppkey").cast("string"), F.lit(" -> works in -> "), "n_name", F.lit("\nbad -> 12 -> line\n"),
        "n_name", F.lit(" -> hosts -> Supplier "), F.col("s_suppkey").cast("string"), F.lit("\nnot a relation"),
    )
    return joined.select("s_suppkey", text.alias("note"))


SQL_MENTIONS = """SELECT s_suppkey AS query_id, unnest(['Supplier '||s_suppkey, n_name]) AS name FROM supplier JOIN nation ON s_nationkey=n_nationkey"""
query("h14_entity_mentions", SQL_MENTIONS)(lambda t: G.entity_mentions(relation_notes(t), "s_suppkey", "note"))
query("h15_community_retrieve", f"""
  SELECT DISTINCT query_id, community_id, summary FROM ({SQL_MENTIONS}) JOIN {SQL_MEMBERS} USING (name) JOIN ({SQL_SUMMARY}) USING (community_id)""")(
    lambda t: M.community_retrieve(G.entity_mentions(relation_notes(t), "s_suppkey", "note"), by_nation(t), summaries(t)).select(
        "query_id", "community_id", "summary"
    )
)
query("h16_graph_stats", f"""
  SELECT document_id, count(*) AS n_triplets, (SELECT count(DISTINCT name) FROM (
      SELECT subject AS name, document_id FROM ({SQL_T}) UNION SELECT object, document_id FROM ({SQL_T})) x WHERE x.document_id = y.document_id) AS n_entities
  FROM ({SQL_T}) y GROUP BY 1""")(lambda t: G.graph_stats(triplets(t)))
