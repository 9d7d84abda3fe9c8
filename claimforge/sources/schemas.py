"""Canonical schemas of the stored tables, and checks of their closed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "patent_parse_records": "id long, task_id string, patent_number string, title string, holder string, application_date string, priority_date string, specification array<struct<seq:int,name:string,text:string>>, parse_errors array<struct<error_type:string,error_message:string,affected_section:string,is_recoverable:boolean>>, created_at timestamp",
    "patent_claims": "id long, record_id long, claim_id string, claim_type string, claim_text string, parent_claim_id string, sentence_units array<string>",
    "patent_figures": "id long, record_id long, figure_id string, figure_url string, figure_description string, storage_key string, file_path string, mime_type string, file_size int, file_sha256 string",
    "keyword_runs": "id long, patent_record_id long, analysis_session_id string, variant string, created_at timestamp",
    "keyword_records": "id long, keyword_run_id long, patent_record_id long, analysis_session_id string, keyword_id string, claim_id string, keyword_text string, keyword_type string, keyword_type_raw string, source_location string, generation_method string, confidence_score double, raw_payload string",
    "search_runs": "id long, patent_record_id long, analysis_session_id string, retrieval_start_time string, platforms_queried array<string>, success boolean, created_at timestamp",
    "search_products": "id long, search_run_id long, patent_record_id long, analysis_session_id string, product_id string, product_name string, product_url string, product_source string, price string, brand string, manufacturer string, matched_keywords string, description string, picture array<string>, raw_payload string",
    "claim_compare_runs": "id long, run_id string, patent_record_id long, analysis_session_id string, status string, error_message string, result_summary string, started_at timestamp, finished_at timestamp",
    "claim_compare_results": "id long, claim_compare_run_id long, product_id string, product_name string, claim_id string, feature_id string, feature_text string, evidence string, comparison_result string, reason string, reasoning_type string, evidence_images array<string>, raw_payload string",
    "users": "id long, name string, email string, role string, status string, approved_by long, created_at timestamp",
    "auth_sessions": "id string, user_id long, expires_at timestamp",
    "analysis_sessions": "id string, user_id long, status string, title string, results map<string,string>, created_at timestamp",
    "analysis_steps": "id long, session_id string, step_id int, status string, error string, started_at timestamp, completed_at timestamp",
    "error_reports": "id long, user_id long, session_id string, message string, stack string, details string, page_url string, user_agent string, created_at timestamp",
}
#: Closed values by table and column.
VALUES = {
    ("patent_claims", "claim_type"): ("INDEPENDENT", "DEPENDENT"),
    ("claim_compare_results", "comparison_result"): ("MATCH", "NO_MATCH", "UNCERTAIN"),
    ("analysis_steps", "status"): ("pending", "running", "waiting_input", "completed", "error"),
    ("users", "status"): ("pending", "approved", "rejected"),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """The table's columns in order: missing ones null, others cast (null where a cast fails); additive evolution."""
    want = empty(df.sparkSession, name).schema
    return df.select(*((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want))


def invalid(name: str, column: str) -> Column:
    """True where a closed value isn't one of the table's."""
    return F.col(column).isNotNull() & ~F.col(column).isin(*VALUES[name, column])
