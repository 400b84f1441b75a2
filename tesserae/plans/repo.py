"""A repository as tables, derived row by row from the given ones, so that it grows with them.

The expressions are plain enough to mean the same in Spark and in the SQL that queries are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NL, BLOCK = "chr(10)", "(doc_id - doc_id % 50)"
AREA = "CASE CAST(floor(doc_id / 10) AS BIGINT) % 5 WHEN 0 THEN 'app' WHEN 1 THEN 'auth' WHEN 2 THEN 'db' WHEN 3 THEN 'locales' ELSE 'core' END"
#: A file for each document: scripts, tests, Python modules and packages, Go, Rust and notes, in five areas.
PATH = f"""CASE doc_id % 10
 WHEN 0 THEN 'src/' || {AREA} || '/m' || doc_id || '.ts' WHEN 1 THEN 'src/' || {AREA} || '/m' || doc_id || '.tsx'
 WHEN 2 THEN 'src/' || {AREA} || '/m' || doc_id || '/index.ts' WHEN 3 THEN 'src/' || {AREA} || '/m' || doc_id || '.js'
 WHEN 4 THEN 'src/' || {AREA} || '/m' || (doc_id - 1) || '.test.js' WHEN 5 THEN 'lib/' || {AREA} || '/p' || doc_id || '.py'
 WHEN 6 THEN 'lib/' || {AREA} || '/k' || doc_id || '/__init__.py' WHEN 7 THEN 'svc/' || {AREA} || '/m' || doc_id || '.go'
 WHEN 8 THEN CASE WHEN doc_id = 8 THEN 'crate/src/lib.rs' ELSE 'crate/src/' || {AREA} || '/r' || doc_id || '.rs' END
 ELSE 'docs/' || {AREA} || '/userGuide' || doc_id || '.md' END"""
MARK = """CASE doc_id % 7 WHEN 0 THEN 'const { t } = useTranslation(); class AppError extends Error {}' WHEN 1 THEN 'z.object({}); router.get("/a")' WHEN 2 THEN 'useQuery(k); process.env.NEXT_PUBLIC_' || (doc_id % 9)
 WHEN 3 THEN 'jwt.verify(x); export default f' WHEN 4 THEN 'export const a = styled.div; process.env.SECRET_' || (doc_id % 5) WHEN 5 THEN 'import.meta.env.VITE_A; process.env.NODE_ENV; createSlice(s)' ELSE 'prisma.user; export function g() {}' END"""
PYTHON_MARK = "CASE doc_id % 3 WHEN 0 THEN 'from pydantic import BaseModel' WHEN 1 THEN 'from sqlalchemy import x' ELSE 'app = FastAPI()' END"
CONTENT = f"""CASE WHEN doc_id % 10 < 4 THEN 'import {{ a }} from "./m' || (doc_id + 50) || '";' || {NL} || 'export * from "../core/m' || ({BLOCK} + 40 + doc_id % 10) || '";' || {NL}
   || 'const z = require("@/auth/m' || ({BLOCK} + 10 + doc_id % 10) || '.js");' || {NL} || 'const y = import("~/db/m' || ({BLOCK} + 20 + (doc_id + 1) % 4) || '");' || {NL} || {MARK}
 WHEN doc_id % 10 = 4 THEN 'import m from "./m' || (doc_id - 1) || '";' || {NL} || 'describe("m", () => {{ it("works", () => expect(m).toBe(1)) }})'
 WHEN doc_id % 10 = 5 THEN 'from .p' || (doc_id + 50) || ' import a' || {NL} || 'from ..core.p' || ({BLOCK} + 45) || ' import b' || {NL} || 'import db.p' || ({BLOCK} + 25) || {NL} || 'from . import c' || {NL} || {PYTHON_MARK}
 WHEN doc_id % 10 = 6 THEN 'from ..p' || (doc_id - 1) || ' import x'
 WHEN doc_id % 10 = 7 THEN 'package m' || {NL} || 'import (' || {NL} || ' "example.org/m/svc/core"' || {NL} || ' "fmt"' || {NL} || ')' || {NL} || 'import "example.org/m/svc/db"' || {NL} || 'if err != nil {{ fmt.Errorf("%w", err) }}'
 WHEN doc_id % 10 = 8 THEN 'mod r' || (doc_id + 50) || ';' || {NL} || 'use crate::core::r' || ({BLOCK} + 48) || '::thing;' || {NL} || 'use super::lib;'
 ELSE CASE WHEN doc_id % 3 = 0 THEN '# This file is generated by a tool' ELSE '# Guide' END END || {NL} || coalesce(text, '')"""
#: A commit for each order, with the parts of its lines as files.
SUBJECT = """CASE o_orderkey % 12 WHEN 0 THEN 'feat(' || lower(o_orderstatus) || '): add ' || o_custkey WHEN 1 THEN 'fix: repair ' || o_custkey WHEN 2 THEN 'Revert "feat: try ' || o_custkey || '"'
 WHEN 3 THEN 'Revert "bump parts to ' || o_custkey || '"' WHEN 4 THEN 'chore(release): ' || o_custkey WHEN 5 THEN 'docs(site): tell ' || o_custkey WHEN 6 THEN 'refactor(core)!: move ' || o_custkey
 WHEN 7 THEN 'wip ' || o_custkey ELSE 'fix(' || lower(substr(o_orderpriority, 3)) || '): mend ' || o_custkey END"""
STATUS = "CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END"
#: A finding for each part.
CATEGORY = """CASE p_size % 9 WHEN 0 THEN 'Core modules' WHEN 1 THEN 'Fragile code' WHEN 2 THEN 'Dominant patterns' WHEN 3 THEN 'Commit conventions' WHEN 4 THEN 'Git history'
 WHEN 5 THEN 'Circular dependencies' WHEN 6 THEN 'Testing' WHEN 7 THEN 'Import conventions' ELSE 'Error handling' END"""
DESCRIPTION = """p_name || CASE p_size % 6 WHEN 0 THEN ' must never break src/app/m' || (p_partkey - p_partkey % 50) || '.ts' WHEN 1 THEN ' uses API routes. Follow this pattern for new ones.' WHEN 2 THEN ' has validation schema in index.ts'
 WHEN 3 THEN ' is hidden coupling' WHEN 4 THEN ' keeps auth session' ELSE ' is plain' END"""
SURE = "CASE WHEN p_size > 30 THEN 'high' WHEN p_size > 12 THEN 'medium' ELSE 'low' END"

FILES_SQL = f"SELECT {PATH} AS path, {CONTENT} AS content FROM documents"
COMMITS_SQL = f"SELECT o_orderkey AS commit_id, o_orderdate AS ts, {SUBJECT} AS subject FROM orders"
COMMIT_FILES_SQL = f"SELECT o_orderkey AS commit_id, o_orderdate AS ts, {SUBJECT} AS subject, {STATUS} AS status, 'src/p' || l_partkey || '.ts' AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
FINDINGS_SQL = f"SELECT p_partkey AS id, {CATEGORY} AS category, {DESCRIPTION} AS description, {SURE} AS confidence FROM part"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(f"{PATH} AS path", f"{CONTENT} AS content")


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS commit_id", "o_orderdate AS ts", f"{SUBJECT} AS subject")


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.selectExpr("o_orderkey AS commit_id", "o_orderdate AS ts", f"{SUBJECT} AS subject", f"{STATUS} AS status", "'src/p' || l_partkey || '.ts' AS path")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """(id, category, description, confidence, evidence): each names the file of a document as its evidence."""
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", f"{CATEGORY} AS category", f"{DESCRIPTION} AS description", f"{SURE} AS confidence")
    return rows.withColumn("evidence", F.array(F.concat(F.lit("src/app/m"), (F.col("id") - F.col("id") % 50).cast("string"), F.lit(".ts"))))
