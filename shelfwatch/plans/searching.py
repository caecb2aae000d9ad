"""Search and comparison jobs over the test tables."""

from pyspark.sql import functions as F

from shelfwatch.functions.constants import DESCRIPTOR_TOKENS, MUTATION_PHRASES, STAT_TOKENS
from shelfwatch.operators import compare, identity, search
from shelfwatch.plans.fixtures import oracle
from shelfwatch.plans.registry import job

QUERY = "Divine  Blue-Bolt"
NORM = "divine blue bolt"
PLAIN = "blue bolt"


def titles(s):
    shown = {"active": F.lit(True), "title": F.col("normalized_title"), "image_url": F.concat(F.lit("https://cdn.example.com/"), F.col("id").cast("string"))}
    return s.market_titles.withColumns(shown)


def _in(tokens):
    return "(" + ", ".join(f"'{t}'" for t in tokens) + ")"


@job("query_tokens", """
    SELECT DISTINCT id, variant FROM (
      SELECT id, unnest([t, CASE WHEN len(t) > 4 THEN t[:4] END, CASE WHEN len(t) > 6 THEN t[:6] END]) AS variant
      FROM (SELECT p_partkey AS id, unnest(string_split(concat(p_name, ' ', lower(p_type)), ' ')) AS t FROM part) x) y
    WHERE variant IS NOT NULL""")
def query_tokens(s):
    text = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    return s.table("part").select(F.col("p_partkey").alias("id"), F.explode(search.token_variants(text)).alias("variant"))


# The sequence ratio of (a, b): the longest common block, the first in a and then in b where several are as long, and the same again on
# both sides of it.
def _block(x, y):
    return f"""list_filter(flatten(list_transform(range(least(len({x}), len({y})), 0, -1), lambda k: list_transform(range(1, len({x}) - k + 2), lambda i: {{'k': k, 'i': i}}))),
               lambda c: contains({y}, substring({x}, c.i, c.k)))[1]"""


RATIOS = {
    "blocks": f"""
    SELECT a, b, a AS x, b AS y, {_block('a', 'b')} AS m FROM pairs
    UNION ALL
    SELECT a, b, n.x, n.y, {_block('n.x', 'n.y')} FROM (
      SELECT a, b, unnest([{{'x': substring(x, 1, m.i - 1), 'y': substring(y, 1, j - 1)}}, {{'x': substring(x, m.i + m.k), 'y': substring(y, j + m.k)}}]) AS n
      FROM (SELECT *, strpos(y, substring(x, m.i, m.k)) AS j FROM blocks WHERE m IS NOT NULL) f) g
    WHERE len(n.x) > 0 AND len(n.y) > 0""",
    "ratios": "SELECT a, b, 2.0::DOUBLE * coalesce(sum(m.k), 0) / (len(a) + len(b)) AS ratio FROM blocks GROUP BY a, b",
}


def match_ctes(texts):
    """The match score of the query and every text t of a SELECT, as `scored`."""
    return {
        "texts": texts,
        "pairs": f"""
    SELECT '{NORM}' AS a, t AS b FROM texts
    UNION SELECT q, w FROM (SELECT DISTINCT unnest(string_split(t, ' ')) AS w FROM texts) x, (SELECT unnest(string_split('{NORM}', ' ')) AS q) y""", **RATIOS,
        "best_words": "SELECT t, max(ratio) AS best FROM (SELECT DISTINCT t, unnest(string_split(t, ' ')) AS w FROM texts) x JOIN ratios ON b = w AND a <> '"
                      + NORM + "' GROUP BY t",
        "scored": f"""
    SELECT x.t, CASE WHEN contains(x.t, '{NORM}') THEN 1.0::DOUBLE
                     ELSE greatest(len(list_intersect(string_split('{NORM}', ' '), string_split(x.t, ' '))) / 3.0::DOUBLE * 0.9::DOUBLE, r.ratio * 0.8::DOUBLE,
                                   best * 0.7::DOUBLE) END AS score
    FROM texts x JOIN ratios r ON r.a = '{NORM}' AND r.b = x.t JOIN best_words w ON w.t = x.t""",
    }


CANDIDATE = " OR ".join(f"contains(normalized_title, '{v}')" for v in ("divine", "divi", "blue", "bolt"))


@job("search_candidates", oracle(f"SELECT id, normalized_title FROM market_titles WHERE {CANDIDATE}", "market_titles"))
def search_candidates(s):
    return search.search_candidates(titles(s), QUERY, blocked=True).select("id", "normalized_title")


@job("match_scores_exact", oracle(f"""
    SELECT id, CAST(CASE WHEN contains(normalized_title, '{NORM}') THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score FROM market_titles
    WHERE contains(normalized_title, '{NORM}')
       OR len(list_filter(['divine', 'blue', 'bolt'], lambda x: NOT list_contains(string_split(normalized_title, ' '), x))) = 0""", "market_titles"))
def match_scores_exact(s):
    return search.exact_match_scores(titles(s), F.lit(NORM), F.col("normalized_title")).select("id", "score")


TITLES = match_ctes("SELECT DISTINCT normalized_title AS t FROM market_titles")


@job("match_scores", oracle("""
    SELECT id, normalized_title, round(score, 9) AS score FROM market_titles JOIN scored ON t = normalized_title""", "market_titles", **TITLES))
def match_scores(s):
    return search.with_match_score(titles(s), F.lit(NORM), F.col("normalized_title")).select("id", "normalized_title", F.round("score", 9).alias("score"))


@job("search_products", oracle("""
    SELECT m.id, m.normalized_title, c.name AS competitor_name, m.current_price, round(score, 3) AS match_score
    FROM market_titles m JOIN scored ON t = normalized_title JOIN competitors c ON c.id = m.competitor_id WHERE score >= 0.34
    ORDER BY match_score DESC, m.current_price, m.id LIMIT 50""", "market_titles", "competitors", **TITLES))
def search_products(s):
    return search.search_products(titles(s), s.competitors, QUERY).select("id", "normalized_title", "competitor_name", "current_price", "match_score")


# --- identity ----------------------------------------------------------------------------------------------

def _gap(text):
    for phrase in MUTATION_PHRASES:
        text = f"regexp_replace({text}, ' {phrase} ', ' # ')"
    return text


_PHRASES = "[" + ", ".join(f"'{p}'" for p in MUTATION_PHRASES) + "]"
IDENTITY = f"""
    SELECT *, concat(base, '::', mutation) AS identity_key,
           array_to_string(list_transform(string_split(mutation, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS label,
           array_to_string(list_transform(string_split(base, ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS shown
    FROM (
      SELECT *, coalesce(CASE WHEN split THEN nullif(base_part, '') END, nullif(cleaned, ''), normalized_title) AS base,
             CASE WHEN split AND len(found) > 0 THEN array_to_string(found, ' ') ELSE 'normal' END AS mutation
      FROM (
        SELECT *, list_filter({_PHRASES}, lambda p: contains(concat(' ', cleaned, ' '), concat(' ', p, ' '))) AS found,
               trim(regexp_replace(replace({_gap("concat(' ', cleaned, ' ')")}, '#', ' '), ' +', ' ', 'g')) AS base_part,
               contains(lower(category), 'brainrot') OR contains(lower(category), 'escape tsunami') OR contains(normalized_title, 'brainrot')
                 OR len(list_filter(string_split(normalized_title, ' '), lambda t: regexp_matches(t, '[0-9]') AND regexp_matches(t, 'm|b|qn'))) > 0 AS split
        FROM (
          SELECT *, array_to_string(list_filter(string_split(normalized_title, ' '),
                    lambda t: NOT regexp_matches(t, '[0-9]') AND t NOT IN {_in(STAT_TOKENS)}), ' ') AS cleaned FROM market_titles) a) b) c"""


# Every title as a query, against every title.
MANY = {
    "texts": "SELECT DISTINCT normalized_title AS t FROM market_titles",
    "words": "SELECT DISTINCT t, unnest(string_split(t, ' ')) AS w FROM texts",
    "variants": "SELECT DISTINCT t, unnest([w, CASE WHEN len(w) > 4 THEN w[:4] END, CASE WHEN len(w) > 6 THEN w[:6] END]) AS v FROM words",
    "found": "SELECT DISTINCT q.t AS q, x.t FROM (SELECT t, v FROM variants WHERE len(v) >= 2) q JOIN texts x ON contains(x.t, q.v)",
    "pairs": "SELECT q AS a, t AS b FROM found UNION SELECT a.w, b.w FROM (SELECT DISTINCT w FROM words) a, (SELECT DISTINCT w FROM words) b",
    **RATIOS,
    "best_words": """
    SELECT f.q, f.t, max(ratio) AS best FROM found f JOIN words a ON a.t = f.q JOIN words b ON b.t = f.t JOIN ratios r ON r.a = a.w AND r.b = b.w GROUP BY f.q, f.t""",
    "hits": """
    SELECT f.q, f.t, CASE WHEN contains(f.t, f.q) THEN 1.0::DOUBLE
        ELSE greatest(len(list_intersect(string_split(f.q, ' '), string_split(f.t, ' '))) / len(list_distinct(string_split(f.q, ' ')))::DOUBLE * 0.9::DOUBLE,
                      r.ratio * 0.8::DOUBLE, best * 0.7::DOUBLE) END AS score
    FROM found f JOIN ratios r ON r.a = f.q AND r.b = f.t JOIN best_words w ON w.q = f.q AND w.t = f.t""",
}


@job("search_many", oracle("SELECT q AS query, t AS title, round(score, 3) AS match_score FROM hits WHERE score >= 0.34", "market_titles", **MANY))
def search_many(s):
    rows = titles(s)
    return search.search_many(rows.select(F.col("normalized_title").alias("query")), rows.select("title"))


# The query has its variant phrase taken out: what is left of it is the base that a title must have to be split by the query.
HINTED = """
    SELECT *, concat(base, '::', mutation) AS identity_key FROM (
      SELECT id, competitor_id, normalized_title, category, current_price, last_checked_at,
             coalesce(CASE WHEN s THEN nullif(base_part, '') END, nullif(cleaned, ''), normalized_title) AS base,
             CASE WHEN s AND len(found) > 0 THEN array_to_string(found, ' ') ELSE 'normal' END AS mutation
      FROM (SELECT *, split OR (len(found) > 0 AND base_part = 'blue bolt') AS s FROM named) x) y"""
SUGGESTED = match_ctes("SELECT normalized_title AS t FROM hinted UNION SELECT base FROM hinted") | {"hits": """
    SELECT h.*, c.name AS competitor_name, greatest(a.score, b.score) AS score FROM hinted h JOIN scored a ON a.t = normalized_title JOIN scored b ON b.t = base
    JOIN competitors c ON c.id = h.competitor_id WHERE greatest(a.score, b.score) >= 0.34"""}


@job("search_suggestions", oracle("""
    SELECT identity_key, round(max(score), 3) AS match_score, count(DISTINCT competitor_name) AS competitors_count, count(*) AS n_products,
           min(current_price) AS best_price, arg_min(id, ROW(current_price, -epoch_us(last_checked_at), id)) AS representative_product_id,
           concat('https://cdn.example.com/', CAST(arg_min(id, ROW(current_price, -epoch_us(last_checked_at), id)) AS VARCHAR)) AS image_url,
           array_to_string(list_sort(list_distinct(list(normalized_title)))[1:5], '|') AS variants
    FROM hits GROUP BY identity_key ORDER BY match_score DESC, competitors_count DESC, best_price, identity_key LIMIT 20""",
    "market_titles", "competitors", named=IDENTITY, hinted=HINTED, **SUGGESTED))
def search_suggestions(s):
    rows = search.search_suggestions(titles(s), s.competitors, QUERY).withColumn("variants", F.array_join("variants", "|"))
    return rows.select("identity_key", "match_score", "competitors_count", "n_products", "best_price", "representative_product_id", "image_url", "variants")


@job("suggestion_competitors", oracle("SELECT DISTINCT identity_key, competitor_name FROM hits",
                                      "market_titles", "competitors", named=IDENTITY, hinted=HINTED, **SUGGESTED))
def suggestion_competitors(s):
    return search.group_competitors(search.suggestion_rows(titles(s), s.competitors, QUERY))


@job("market_identity", oracle("""
    SELECT id, identity_key, base, mutation, label AS mutation_label,
           CASE WHEN mutation = 'normal' THEN shown ELSE concat(label, ' ', shown) END AS display_title FROM named""",
    "market_titles", named=IDENTITY))
def market_identity(s):
    return identity.with_identity(titles(s)).select("id", "identity_key", "base", "mutation", "mutation_label", "display_title")


@job("identity_groups", oracle("""
    SELECT identity_key, count(*) AS n_products, count(DISTINCT c.name) AS competitors_count, min(current_price) AS best_price,
           arg_min(n.category, ROW(-epoch_us(last_checked_at), n.id)) AS category
    FROM named n JOIN competitors c ON n.competitor_id = c.id GROUP BY identity_key""", "market_titles", "competitors", named=IDENTITY))
def identity_groups(s):
    from shelfwatch.sources.tables import with_competitor

    rows = with_competitor(identity.with_identity(titles(s)), s.competitors).withColumn("match_score", F.lit(1.0))
    return search.identity_groups(rows).select("identity_key", "n_products", "competitors_count", "best_price", "category")


@job("group_variants", oracle("""
    SELECT identity_key, normalized_title, CAST(row_number() OVER (PARTITION BY identity_key ORDER BY normalized_title) AS INT) AS pos
    FROM (SELECT DISTINCT identity_key, normalized_title FROM named) d QUALIFY pos <= 5""", "market_titles", named=IDENTITY))
def group_variants(s):
    return search.group_variants(identity.with_identity(titles(s)), title="normalized_title")


@job("comparison_aliases", oracle(f"""
    SELECT DISTINCT id, unnest([normalized_title, nullif(array_to_string(list_filter(string_split(normalized_title, ' '),
           lambda t: t NOT IN {_in(DESCRIPTOR_TOKENS)}), ' '), '')]) AS alias FROM market_titles""", "market_titles"))
def comparison_aliases(s):
    # part numbers above a million reach into the next supplier's ids, so an id may have several titles and aliases may repeat
    return s.market_titles.select("id", F.explode(identity.comparison_aliases(F.col("normalized_title"))).alias("alias")).distinct()


# The comparison score of two texts, from their ratio.
COMPARED = """
    CASE WHEN a = b THEN 1.0::DOUBLE
         WHEN len(string_split(a, ' ')) = 1 AND list_contains(string_split(b, ' '), a) THEN 0.72::DOUBLE
         WHEN len(list_filter(string_split(a, ' '), lambda w: NOT list_contains(string_split(b, ' '), w))) = 0 THEN 0.9::DOUBLE ELSE ratio END"""


@job("comparison_scores", oracle(f"""
    SELECT id, normalized_title, round({COMPARED}, 9) AS score FROM market_titles JOIN ratios ON b = normalized_title""",
    "market_titles", pairs=f"SELECT DISTINCT '{PLAIN}' AS a, normalized_title AS b FROM market_titles", **RATIOS))
def comparison_scores(s):
    rows = compare.with_comparison_score(titles(s), [(F.lit(PLAIN), F.col("normalized_title"))])
    return rows.select("id", "normalized_title", F.round("score", 9).alias("score"))


def _descriptors(base):
    return f"nullif(array_to_string(list_filter(string_split({base}, ' '), lambda w: w NOT IN {_in(DESCRIPTOR_TOKENS)}), ' '), '')"


# Every identity against every reading of every title; a reading by a hint is for targets of that base only, and bars the other one from them.
FUZZY = {
    "named": IDENTITY,
    "readings": """
    SELECT id, competitor_id, normalized_title, current_price, base, mutation, NULL AS hint,
           CASE WHEN NOT split AND len(found) > 0 AND base_part <> '' THEN base_part END AS barred FROM named
    UNION ALL SELECT id, competitor_id, normalized_title, current_price, base_part, array_to_string(found, ' '), base_part, base_part FROM named
    WHERE NOT split AND len(found) > 0 AND base_part <> ''""",
    "targets": "SELECT DISTINCT base, mutation FROM named",
    "aliases": f"""
    SELECT DISTINCT base, unnest(list_distinct(list_filter([base, {_descriptors('base')}], lambda x: x IS NOT NULL))) AS alias
    FROM (SELECT base FROM targets UNION SELECT base FROM readings) x""",
    "pairs": """
    SELECT DISTINCT t.alias AS a, c.alias AS b FROM (SELECT DISTINCT alias FROM targets JOIN aliases USING (base)) t,
           (SELECT DISTINCT alias FROM readings JOIN aliases USING (base)) c""",
    **RATIOS,
    "base_scores": f"""
    SELECT t.base AS target, c.base AS base, max({COMPARED}) AS score FROM aliases t JOIN ratios ON a = t.alias JOIN aliases c ON b = c.alias GROUP BY t.base, c.base""",
    "matches": """
    SELECT t.base, t.mutation, r.competitor_id, s.score, r.id, r.normalized_title, r.current_price
    FROM targets t JOIN base_scores s ON s.target = t.base JOIN readings r ON r.base = s.base AND r.mutation = t.mutation
    WHERE s.score >= 0.86 AND CASE WHEN r.hint IS NOT NULL THEN r.hint = t.base ELSE r.barred IS DISTINCT FROM t.base END""",
    "best": """
    SELECT *, row_number() OVER (PARTITION BY base, mutation, competitor_id ORDER BY score DESC, current_price, id) AS pos FROM matches QUALIFY pos = 1""",
}


@job("compare_product", oracle(f"""
    SELECT c.id AS competitor_id, c.name AS competitor_name, coalesce(round(b.score, 3), 0) AS match_score, b.id AS product_id, b.normalized_title, b.current_price
    FROM competitors c LEFT JOIN (SELECT best.* FROM best JOIN target USING (base, mutation)) b ON b.competitor_id = c.id WHERE c.active""",
    "market_titles", "competitors", **FUZZY, target=f"""
    SELECT base, mutation FROM named JOIN ratios ON a = '{PLAIN}' AND b = normalized_title
    ORDER BY {COMPARED} DESC, last_checked_at DESC, id LIMIT 1""".replace("JOIN ratios ON", "JOIN (SELECT * FROM target_ratios) q ON"))
    .replace("target AS (", f"""target_blocks AS ({RATIOS['blocks'].replace('FROM pairs', f"FROM (SELECT DISTINCT '{PLAIN}' AS a, normalized_title AS b FROM market_titles) p").replace('FROM blocks', 'FROM target_blocks')}),
    target_ratios AS ({RATIOS['ratios'].replace('FROM blocks', 'FROM target_blocks')}), target AS ("""))
def compare_product(s):
    rows = titles(s)
    return compare.compare_product(rows, s.competitors, compare.compare_target(rows, q=PLAIN)).drop("currency")


@job("comparison_head", oracle(f"""
    SELECT n.id AS target_id, identity_key, n.base, n.mutation, label AS mutation_label,
           CASE WHEN n.mutation = 'normal' THEN shown ELSE concat(label, ' ', shown) END AS display_title,
           array_to_string(list_sort(list_distinct(list_filter([n.base, {_descriptors('n.base')}], lambda x: x IS NOT NULL))), '|') AS aliases,
           (SELECT count(*) FROM best b JOIN competitors c ON c.id = b.competitor_id WHERE c.active AND b.base = n.base AND b.mutation = n.mutation) AS total_matches
    FROM named n ORDER BY n.id LIMIT 1""", "market_titles", "competitors", **FUZZY))
def comparison_head(s):
    rows = titles(s)
    target = compare.compare_target(rows, product_id=rows.agg(F.min("id")).first()[0])
    head = compare.comparison_head(target, compare.compare_product(rows, s.competitors, target))
    return head.withColumn("aliases", F.array_join("aliases", "|"))


@job("market_comparison_fuzzy", oracle("""
    SELECT base, mutation, competitor_id, round(score, 3) AS match_score, id AS product_id, normalized_title, current_price FROM best""",
    "market_titles", **FUZZY))
def market_comparison_fuzzy(s):
    return compare.market_comparison_fuzzy(titles(s))


@job("market_comparison", oracle("""
    SELECT o.*, m.n_competitors, m.low, m.high, m.cheapest.competitor_id AS cheapest_competitor_id, m.cheapest.product_id AS cheapest_product_id,
           m.n_products, m.high - m.low AS spread
    FROM offers o
    JOIN (SELECT base, mutation, count(*) AS n_competitors, min(price) AS low, max(price) AS high,
                 arg_min({'competitor_id': competitor_id, 'product_id': product_id}, ROW(price, competitor_id)) AS cheapest,
                 CAST(sum(n_offers) AS BIGINT) AS n_products FROM offers GROUP BY base, mutation) m
      ON o.base = m.base AND o.mutation = m.mutation""", "market_titles", named=IDENTITY, offers="""
    SELECT base, mutation, competitor_id, min(current_price) AS price, arg_min(id, ROW(current_price, id)) AS product_id, count(*) AS n_offers
    FROM named GROUP BY base, mutation, competitor_id"""))
def market_comparison(s):
    return compare.market_comparison(titles(s))
