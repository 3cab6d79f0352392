"""Schemas of the store's tables, as DDL."""

FACTS = "id long, namespace string, user_id long, content string, subject string, category string, kind string, subsystem string, metadata string, superseded_by long, superseded_at timestamp, confirmed_count int, last_confirmed_at timestamp, use_count int, last_used_at timestamp, embedding array<float>, created_at timestamp, embed_failed_at timestamp, embed_error string"
LINKS = "id long, source_id long, target_id long, link_type string, bidirectional boolean, label string, metadata string, created_at timestamp"
DOCUMENTS = "id long, namespace string, user_id long, repo_url string, commit string, path string, lang string, file_sha256 binary, dirty boolean, trusted boolean, generated boolean, is_test boolean, chunker_version int, chunk_strategy string, title string, front_matter string"
CHUNKS = "document_id long, ordinal int, content string, byte_start int, byte_end int, line_start int, line_end int, heading_path string, heading_level int, lang string, package string, import_path string, symbol string, receiver string, decl_kind string, exported boolean, signature string, scope_path string, imports_used array<string>"
TURNS = "session_id string, uuid string, turn_index int, role string, content string, cwd string, created_at timestamp"
HINTS = "id long, session_id string, cwd string, turn_index int, hint_text string, ref_ids array<string>, retrieved_ids array<string>, candidate_scores map<string,double>, search_query string, ranker_version string, relevance double, desirability double, created_at timestamp, consumed_at timestamp"
INJECTIONS = "session_id string, ref_id string, ref_type string, rank int, injected_at timestamp"
FEEDBACK = "ref_id string, ref_type string, session_id string, score int, reason string"

#: Longest content of a fact, in characters.
MAX_CONTENT = 8000
