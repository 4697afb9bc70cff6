"""Explicit schemas of the code-knowledge tables; nothing is inferred. Partition columns: repo_id, and the day for usage."""

TABLES = {
    "repos": "id string, url string, branch string, commit_hash string, analyzed_at timestamp, total_files int, total_lines long, function_count int, type_count int, languages map<string,int>",
    "files": "repo_id string, path string, hash string, language string, package string, size long, line_count int, purpose string, concepts array<string>, imports array<struct<path:string,alias:string>>",
    "functions": "repo_id string, path string, name string, name_lower string, signature string, description string, receiver string, is_public boolean, line_start long, line_end int, complexity int, "
    "parameters array<struct<name:string,type:string>>, returns array<string>, behavior struct<summary:string,steps:array<string>,patterns:array<string>>, side_effects array<string>",
    "function_calls": "repo_id string, caller_path string, caller string, callee string, callee_package string, callee_file string, line int, call_type string",
    "types": "repo_id string, path string, name string, kind string, description string, is_public boolean, line_start int, line_end int, fields array<struct<name:string,type:string,tag:string,is_public:boolean>>",
    "constants": "repo_id string, path string, name string, type string, value string, is_public boolean, line_start int",
    "side_effects": "repo_id string, path string, name string, line_start int, effect string",
    "concepts": "repo_id string, path string, name string, line_start int, concept string",
    "file_concepts": "repo_id string, path string, concept string",
    "file_hashes": "repo_id string, file_path string, hash string, last_analyzed timestamp, file_size long",
    "orgs": "id string, exclude_patterns array<string>, max_file_size long, created_at timestamp",
    "org_repos": "org_id string, repo_id string, override struct<exclude_patterns:array<string>,max_file_size:long>, added_at timestamp",
    "vectors": "id string, repo_id string, org_id string, type string, name string, file_path string, vector array<double>, metadata map<string,string>",
    "tool_usage": "id long, tool string, input_tokens int, output_tokens int, duration_ms long, success boolean, error_msg string, timestamp timestamp",
}


def empty(spark, name: str):
    """An empty table with its schema."""
    return spark.createDataFrame([], TABLES[name])
