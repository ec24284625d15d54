"""Secrets: candidates judged by how widely the corpus shares them.

Every candidate string of every text is hashed (SHA-256; the secret itself is
never put out) and counted by the distinct repositories and owners it is found
with.  What many owners have is a copied example; what one owner alone has,
and looks random, is a credential that may be live.

``verdict``: 'example' (``wide`` owners or more, or the look of a
placeholder), 'live' (one owner and a random look), 'shared' (between them),
'weak' (one owner, too little variety of characters).

Candidates are found by one expression per kind inside the JVM; three
aggregations on ever fewer rows count occurrences, repositories and owners
without any distinct-count over one hot hash: the first is by (hash, owner,
repository), so a string found in half of all documents is combined in many
tasks.

Nulls: a null text has no candidates; a null repository or owner counts as one
(named ''); an empty text has none; a text of any length is searched whole.
Repeated rows add to occurrences, not to repositories or owners.  An empty
table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, table

#: kind: (expression, a part every match has, which spares most texts the expression). Both engines read them alike.
KINDS = {
    "access_key_id": (r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", r"A[KS]IA"),
    "host_token": (r"\b(gh[pousr]_[A-Za-z0-9]{36,80}|glpat-[A-Za-z0-9_-]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,80}|sk_(?:live|test)_[A-Za-z0-9]{16,64})", r"gh[pousr]_|glpat-|xox|sk_"),
    "web_token": (r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", r"eyJ"),
    "private_key": (r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,})", r"PRIVATE KEY"),
    "assigned": (r"(?i)\b[a-z0-9_-]{0,40}(?:token|secret|passw(?:or)?d|pwd|api_?key|access_?key)[a-z0-9_-]{0,40}[\x22']?\s{0,4}[:=]\s{0,4}[\x22']([^\s\x22']{8,200})[\x22']", r"[:=]\s{0,4}[\x22']"),
    "url_password": (r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,80}:([^\s/@]{4,120})@", r"://"),
}
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-]?|xxxx|\*\*\*\*|dummy|sample|0123456789|1234567890|abcdefgh|<|\$\{)"
WIDE, VARIETY = 3, 8


def _candidates(text: Column, kind: str, rx: str, part: str) -> Column:
    named = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("secret")))
    return F.when(text.rlike(part), named).otherwise(F.array().cast("array<struct<kind:string,secret:string>>"))


def secret_ownership(docs: DataFrame, repository: str = "doc_id", owner: str = "source", wide: int = WIDE, variety: int = VARIETY) -> DataFrame:
    d = Columns(docs, ["text", repository, owner]).df
    found = F.concat(*[_candidates(F.col("_0"), kind, *rx) for kind, rx in KINDS.items()])
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    each = d.filter(F.col("_0").isNotNull()).select(text_of("_1").alias("repository"), text_of("_2").alias("owner"), F.explode(found).alias("f"))
    secret = F.col("f.secret")
    each = each.select("repository", "owner", F.col("f.kind").alias("kind"), F.sha2(secret, 256).alias("secret_hash"),
                       F.size(F.array_distinct(F.split(secret, ""))).alias("variety"), secret.rlike(PLACEHOLDER).alias("placeholder"))
    by = ["kind", "secret_hash", "variety", "placeholder"]
    repositories = each.groupBy(*by, "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = repositories.groupBy(*by, "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    counted = owners.groupBy(*by).agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"), F.sum("n").alias("occurrences"))
    verdict = (F.when((F.col("owners") >= wide) | F.col("placeholder"), "example").when(F.col("owners") > 1, "shared")
               .when(F.col("variety") < variety, "weak").otherwise("live"))
    return counted.select("kind", "secret_hash", "owners", "repositories", "occurrences", verdict.alias("verdict"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ownership(table(spark, sf_dir, "documents"))


def _sql() -> str:
    q = lambda s: s.replace("'", "''")
    each = " UNION ALL ".join(f"SELECT coalesce(cast(doc_id AS VARCHAR), '') AS repository, coalesce(source, '') AS owner, '{kind}' AS kind, unnest(regexp_extract_all(text, '{q(rx)}', 1)) AS secret FROM documents" for kind, (rx, _) in KINDS.items())
    return f"""
WITH e AS ({each}),
c AS (SELECT kind, secret, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories, count(*)::BIGINT AS occurrences,
  len(list_distinct(string_split(secret, ''))) AS variety, regexp_matches(secret, '{q(PLACEHOLDER)}') AS placeholder FROM e GROUP BY kind, secret)
SELECT kind, sha256(secret) AS secret_hash, owners, repositories, occurrences,
  CASE WHEN owners >= {WIDE} OR placeholder THEN 'example' WHEN owners > 1 THEN 'shared' WHEN variety < {VARIETY} THEN 'weak' ELSE 'live' END AS verdict FROM c"""


QUERIES = {"op5_secret_ownership": op5_secret_ownership}
ORACLE_SQL = {"op5_secret_ownership": _sql()}
