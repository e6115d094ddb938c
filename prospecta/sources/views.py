"""CRM relations over the star-schema test tables.

Each view is a projection of one base table, given as portable SQL expressions, so that
Spark and a SQL oracle see the same rows.  Nulls, case variants, second tenants and
repeated addresses are made by rule from the keys.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..context import Workspace

#: The reports' day: no query reads the clock.
AS_OF = "2026-06-30"

#: Placeholder {ago:x} is the day x days before AS_OF in either dialect.
_AGO = {"spark": "date_sub(DATE'2026-06-30', CAST({x} AS INT))", "duckdb": "(DATE '2026-06-30' - CAST({x} AS INT))"}

#: Placeholder {sha:x} is the SHA-256 of a text as lower-case hex.
_SHA = {"spark": "sha2({x}, 256)", "duckdb": "sha256({x})"}

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "companies": (
        "customer",
        {
            "id": "c_custkey",
            "workspace_id": "'w' || CAST(c_custkey % 2 AS STRING)",
            "siren": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lpad(CAST((c_custkey * 7919) % 1000000000 AS STRING), 9, '0') END",
            "denomination": "CASE c_custkey % 6 WHEN 0 THEN 'Société  de la ' || c_name WHEN 1 THEN 'Les Étoiles du ' || c_name WHEN 2 THEN 'Café  Noël ' || CAST(c_custkey % 40 AS STRING) WHEN 3 THEN 'Acme Tech ' || CAST(c_custkey % 25 AS STRING) WHEN 4 THEN 'DE LA Forge ' || c_name ELSE c_name END",
            "naf": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE lpad(CAST((c_custkey * 13) % 99 + 1 AS STRING), 2, '0') || lpad(CAST(c_custkey % 100 AS STRING), 2, '0') || 'Z' END",
            "postcode": "CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '20' || lpad(CAST((c_custkey * 7) % 300 AS STRING), 3, '0') WHEN c_custkey % 19 = 0 THEN '97' || lpad(CAST((c_custkey * 3) % 700 AS STRING), 3, '0') ELSE lpad(CAST((c_custkey * 37) % 95 + 1 AS STRING), 2, '0') || '0' || lpad(CAST(c_custkey % 20 AS STRING), 2, '0') END",
            "city": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'Ville ' || CAST(c_custkey % 30 AS STRING) END",
            "effectif_range": "CASE c_custkey % 18 WHEN 0 THEN '00' WHEN 1 THEN '01' WHEN 2 THEN '02' WHEN 3 THEN '03' WHEN 4 THEN '11' WHEN 5 THEN '12' WHEN 6 THEN '21' WHEN 7 THEN '22' WHEN 8 THEN '31' WHEN 9 THEN '32' WHEN 10 THEN '41' WHEN 11 THEN '42' WHEN 12 THEN '51' WHEN 13 THEN '52' WHEN 14 THEN '53' WHEN 15 THEN 'NN' ELSE NULL END",
            "effectif_min": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST((c_custkey * 3) % 600 AS INT) END",
            "effectif_max": "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST((c_custkey * 31) % 7000 AS INT) END",
            "is_artisan": "c_custkey % 5 = 0",
            "department_code": "CASE c_custkey % 5 WHEN 0 THEN '38' WHEN 1 THEN '69' WHEN 2 THEN '75' WHEN 3 THEN NULL ELSE '31' END",
            "size_category": "CASE c_custkey % 7 WHEN 0 THEN 'PME' WHEN 1 THEN 'TPE' WHEN 2 THEN 'ETI' WHEN 3 THEN NULL WHEN 4 THEN 'GE' WHEN 5 THEN 'PME' ELSE 'TPE' END",
            "sector_main": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE lower(c_mktsegment) END",
            "best_email_confidence": "CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE NULL END",
            "prospection_status": "CASE c_custkey % 5 WHEN 0 THEN 'ready_for_outreach' WHEN 1 THEN 'pending' WHEN 2 THEN 'partial_email' WHEN 3 THEN 'archived_no_email' ELSE 'pending' END",
            "archive_reason": "CASE WHEN c_custkey % 5 = 3 THEN (CASE WHEN c_custkey % 2 = 0 THEN 'no_email' ELSE 'entreprise_radiee' END) ELSE NULL END",
            "quality_score": "CAST(greatest(0, least(100, floor((c_acctbal + 1000) / 110))) AS INT)",
            "relation_type": "CASE c_custkey % 9 WHEN 0 THEN 'client' WHEN 1 THEN 'partenaire' WHEN 2 THEN 'presse_media' WHEN 3 THEN 'newsletter' ELSE 'prospect' END",
            "lifecycle_stage": "CASE c_custkey % 8 WHEN 0 THEN 'client' WHEN 1 THEN 'qualifie' WHEN 2 THEN 'opportunite' WHEN 3 THEN 'dormant' WHEN 4 THEN 'perdu' ELSE 'nouveau' END",
            "legal_basis": "CASE c_custkey % 7 WHEN 0 THEN 'consent' WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN 'contract' ELSE 'legitimate_interest_b2b' END",
            "discovery_source": "CASE c_custkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'insee' WHEN 2 THEN 'google-maps' WHEN 3 THEN NULL ELSE 'website' END",
            "email_generic": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN '' ELSE 'Contact@site' || CAST(c_custkey % 50 AS STRING) || '.fr' END",
            "website": "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'https://www.site' || CAST(c_custkey % 50 AS STRING) || '.fr/contact?x=1' WHEN c_custkey % 4 = 2 THEN 'Site' || CAST(c_custkey % 50 AS STRING) || '.co.uk:8080/a' ELSE 'http://shop.eu.site' || CAST(c_custkey % 50 AS STRING) || '.fr' END",
            "phone": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '+33' || CAST(100000000 + (c_custkey * 9973) % 800000000 AS STRING) END",
            "linkedin_url": "CASE WHEN c_custkey % 6 = 1 THEN 'https://linkedin.example/' || CAST(c_custkey AS STRING) ELSE NULL END",
            "address": "CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 10 = 1 THEN NULL ELSE CAST(c_custkey AS STRING) || ' rue Haute' END",
            "lat": "CASE WHEN c_custkey % 3 = 1 THEN NULL ELSE 43.0 + (c_custkey % 700) / 100.0 END",
            "lon": "CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE (c_custkey % 900) / 100.0 - 2.0 END",
            "enseigne": "CASE WHEN c_custkey % 4 = 2 THEN 'Enseigne ' || CAST(c_custkey AS STRING) ELSE NULL END",
            "recent_signals": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 4 AS INT) ELSE NULL END",
            "created_on": "{ago:c_custkey % 400}",
            "enriched_on": "CASE WHEN c_custkey % 6 = 4 THEN NULL ELSE {ago:c_custkey % 90} END",
            "deleted_on": "CASE WHEN c_custkey % 29 = 0 THEN {ago:c_custkey % 30} ELSE NULL END",
        },
    ),
    "contacts": (
        "orders",
        {
            "id": "o_orderkey",
            "company_id": "o_custkey",
            "workspace_id": "'w' || CAST(o_custkey % 2 AS STRING)",
            "first_name": "CASE o_orderkey % 5 WHEN 0 THEN 'Zoé' WHEN 1 THEN 'Jean  Paul' WHEN 2 THEN NULL WHEN 3 THEN 'Ève' ELSE 'Luc' END",
            "last_name": "'Nom' || CAST(o_orderkey % 97 AS STRING)",
            "email": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'P' || CAST(o_orderkey % 300 AS STRING) || '@Site' || CAST(o_custkey % 50 AS STRING) || '.fr' WHEN o_orderkey % 4 = 2 THEN 'p' || CAST(o_orderkey % 300 AS STRING) || '@site' || CAST(o_custkey % 50 AS STRING) || '.fr' ELSE 'q' || CAST(o_orderkey % 200 AS STRING) || '@gmail.com' END",
            "email_status": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'valid' WHEN o_orderstatus = 'O' THEN 'invalid' ELSE 'catchall' END",
            "phone": "CASE WHEN o_orderkey % 3 = 0 THEN '+336' || lpad(CAST((o_orderkey * 7) % 100000000 AS STRING), 8, '0') ELSE NULL END",
            "role": "CASE o_orderkey % 6 WHEN 0 THEN 'Directeur des Ressources Humaines DRH' WHEN 1 THEN 'DAF' WHEN 2 THEN 'Chief Executive Officer' WHEN 3 THEN 'CTO / DSI' WHEN 4 THEN NULL ELSE 'Assistant' END",
            "external_ref": "CASE WHEN o_orderkey % 10 = 0 THEN 'ext-' || CAST(o_orderkey % 500 AS STRING) ELSE NULL END",
            "discovery_source": "CASE o_orderkey % 3 WHEN 0 THEN 'website' WHEN 1 THEN '  ' ELSE 'insee' END",
            "legal_basis": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'consent' ELSE 'legitimate_interest_b2b' END",
            "created_on": "{ago:o_orderkey % 700}",
        },
    ),
    "runs": (
        "events",
        {
            "id": "event_id",
            "workspace_id": "'w' || CAST(user_id % 2 AS STRING)",
            "company_id": "CASE WHEN event_id % 12 = 0 THEN NULL ELSE user_id END",
            "campaign_id": "event_id % 6",
            "source": "CASE user_id % 4 WHEN 0 THEN 'insee' WHEN 1 THEN 'google-maps' WHEN 2 THEN 'website' ELSE 'bodacc' END",
            "status": "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'success' ELSE 'running' END",
            "started_at": "ts",
            "latency_ms": "CAST(floor(value * 10) - 500 AS BIGINT)",
            "payload": "props",
        },
    ),
    "llm_usage": (
        "lineitem",
        {
            "id": "l_orderkey * 10 + l_linenumber",
            "workspace_id": "'w' || CAST(l_suppkey % 2 AS STRING)",
            "use_case_slug": "'case-' || CAST(l_partkey % 5 AS STRING)",
            "provider": "CASE l_returnflag WHEN 'R' THEN 'north' WHEN 'A' THEN 'south' ELSE 'east' END",
            "tokens_input": "CAST(l_quantity * 100 AS BIGINT)",
            "tokens_output": "CAST(l_quantity * 7 AS BIGINT)",
            "cost_micros": "CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)",
            "cache_hit": "l_linestatus = 'F'",
            "created_at": "l_shipdate",
        },
    ),
    "media": (
        "part",
        {
            "id": "p_partkey",
            "workspace_id": "'w' || CAST(p_partkey % 2 AS STRING)",
            "name": "CASE p_partkey % 4 WHEN 0 THEN 'Chaîne de télévision ' || p_name WHEN 1 THEN 'Le  ' || p_name WHEN 2 THEN 'Café Noël ' || CAST(p_partkey % 40 AS STRING) ELSE p_name END",
            "siren": "CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(((p_partkey * 2) * 7919) % 1000000000 AS STRING), 9, '0') ELSE NULL END",
            "parent_media_id": "CASE WHEN p_partkey % 5 = 1 THEN CAST(floor(p_partkey / 2) AS BIGINT) ELSE NULL END",
            "media_type": "lower(p_type)",
            "periodicity": "CASE p_size % 6 WHEN 0 THEN 'Quotidien' WHEN 1 THEN 'hebdomadaire' WHEN 2 THEN 'Mensuelle' WHEN 3 THEN NULL WHEN 4 THEN 'Trimestriel' ELSE 'irrégulier' END",
            "naf": "CASE p_partkey % 6 WHEN 0 THEN '5813Z' WHEN 1 THEN '5814Z' WHEN 2 THEN '6010Z' WHEN 3 THEN '6020A' WHEN 4 THEN '6391Z' ELSE '6201Z' END",
            "email": "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 9 = 0 THEN '' ELSE 'redaction@media' || CAST(p_partkey % 60 AS STRING) || '.fr' END",
            "website": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'https://media' || CAST(p_partkey % 60 AS STRING) || '.fr' END",
            "phone": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '01' || lpad(CAST(p_partkey % 100000000 AS STRING), 8, '0') END",
            "source": "'cppap'",
            "cppap_number": "'C' || CAST(p_partkey AS STRING)",
            "publisher": "p_brand",
            "deleted_on": "CASE WHEN p_partkey % 14 = 0 THEN {ago:p_partkey % 30} ELSE NULL END",
        },
    ),
    "media_batch": (
        "part",
        {
            "row_no": "p_partkey",
            "name": "p_name || ' ' || CAST(p_partkey % 3 AS STRING)",
            "cppap_number": "'C' || CAST(CASE WHEN p_partkey % 10 = 0 THEN p_partkey + 1 WHEN p_partkey % 10 = 7 THEN p_partkey + 1000000 ELSE p_partkey END AS STRING)",
            "publisher": "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || ' SA' END",
            "email": "'new@media' || CAST(p_partkey % 60 AS STRING) || '.fr'",
            "website": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'https://new' || CAST(p_partkey % 60 AS STRING) || '.fr' END",
            "present": "p_partkey % 6 <> 5",
        },
    ),
    "opt_out": (
        "supplier",
        {
            "id": "s_suppkey",
            "email": "CASE WHEN s_suppkey % 2 = 0 THEN 'p' || CAST((s_suppkey * 13) % 300 AS STRING) || '@site' || CAST((s_suppkey * 7) % 50 AS STRING) || '.fr' ELSE ' Q' || CAST((s_suppkey * 3) % 200 AS STRING) || '@gmail.com ' END",
            "scope": "CASE WHEN s_suppkey % 3 = 0 THEN 'vivier' ELSE 'business' END",
            "reason": "CASE s_suppkey % 3 WHEN 0 THEN 'complaint' WHEN 1 THEN 'hard_bounce' ELSE 'manual' END",
            "created_on": "{ago:s_suppkey % 60}",
        },
    ),
    "activities": (
        "events",
        {
            "id": "event_id",
            "workspace_id": "'w' || CAST(user_id % 2 AS STRING)",
            "person_id": "user_id",
            "kind": "CASE event_type WHEN 'signup' THEN 'newsletter_optin' WHEN 'purchase' THEN 'form_submission' WHEN 'view' THEN 'enriched' WHEN 'click' THEN 'calendly_booked' ELSE 'opt_out' END",
            "external_ref": "'ev-' || CAST(event_id % 5000 AS STRING)",
            "occurred_at": "ts",
            "amount": "value",
        },
    ),
}


def _expand(text: str, dialect: str) -> str:
    for name, forms in (("ago", _AGO), ("sha", _SHA)):
        while f"{{{name}:" in text:
            head, _, rest = text.partition(f"{{{name}:")
            inner, _, tail = rest.partition("}")
            text = head + forms[dialect].format(x=inner) + tail
    return text


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the named views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS (SELECT " + ", ".join(f"{_expand(e, 'duckdb')} AS {c}" for c, e in VIEWS[n][1].items()) + f" FROM {VIEWS[n][0]})" for n in names)


class Views:
    """The relations of one data folder; ``scoped`` gives those of one workspace only."""

    def __init__(self, spark: SparkSession, sf_dir: str, workspace: Workspace | None = None):
        self.spark, self.sf_dir, self.workspace = spark, sf_dir, workspace

    def base(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.base(name)
        table, columns = VIEWS[name]
        df = self.base(table).selectExpr(*[f"{_expand(e, 'spark')} AS {c}" for c, e in columns.items()])
        return self.workspace.scope(df) if self.workspace and "workspace_id" in columns else df

    def scoped(self, workspace_id: str) -> Views:
        return Views(self.spark, self.sf_dir, Workspace(workspace_id))

    @cached_property
    def company_tag(self) -> DataFrame:
        """(company_id, slug, assigned_by): tags by what a company's orders hold."""
        from pyspark.sql import functions as F

        lines = self.base("lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
        orders = self.base("orders").select("o_orderkey", "o_custkey")
        pairs = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        slug = F.concat(F.when(F.col("l_linestatus") == "O", "src:").otherwise("sect:"), F.lower("l_returnflag"))
        by = F.when(F.col("l_returnflag") == "R", "user").otherwise("auto")
        return pairs.select(F.col("o_custkey").alias("company_id"), slug.alias("slug"), by.alias("assigned_by")).distinct()


#: The same bridge for DuckDB.
COMPANY_TAG = """company_tag AS (SELECT DISTINCT o_custkey AS company_id, CASE WHEN l_linestatus = 'O' THEN 'src:' ELSE 'sect:' END || lower(l_returnflag) AS slug,
 CASE WHEN l_returnflag = 'R' THEN 'user' ELSE 'auto' END AS assigned_by FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
