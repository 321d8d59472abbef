"""Schemas of the stored tables, as DDL; nothing is inferred."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "documents": (
        "doc_id long, title string, filename string, text string, word_count int, upload_date timestamp, category string, status string, file_format string, user_id string, "
        "originality_percent double, plagiarism_percent_ml double, ai_percent_ml double, copy_percent_ml double, deep_borrow_percent_ml double, processing_time_ms int, "
        "analytics_status string, analytics_error string, analytics_updated_at timestamp, document_type string, faculty_id string, institution_id string"),
    "corpus_sources": "id long, label string, filename string, content string, chunk_count int, indexed_at timestamp, created_at timestamp",
    "corpus_chunks": "id long, source_id long, chunk_index int, content string, embedding array<double>, point_id string, created_at timestamp",
    "plagiarism_matches": (
        "id long, source_document_id long, target_document_id long, similarity_percent double, copy_percent double, deep_borrow_percent double, matched_fragments string, "
        "algorithm string, created_at timestamp"),
    "tasks": "id long, mode string, filename string, payload string, priority int, created_at timestamp",
    "task_events": (
        "task_id long, at timestamp, status string, progress string, error_message string, plagiarism_pct double, copy_pct double, deep_borrow_pct double, ai_pct double, result_json string"),
    "users": "username string, user_role string, email string, full_name string, faculty_id string, institution_id string, created_at timestamp, last_login timestamp",
    "institutions": "id string, name string, created_at timestamp",
    "faculties": "id string, name string, institution_id string, created_at timestamp",
    "document_types": "name string, display_name string, description string, is_active boolean, created_at timestamp",
}
#: Rows that a new store begins with, by table and key column.
SEEDS: dict[str, tuple[str, list[dict]]] = {
    "institutions": ("id", [{"id": "inst-demo", "name": "Demo"}]),
    "faculties": ("id", [{"id": "fac-demo", "name": "Demo", "institution_id": "inst-demo"}]),
    "users": ("username", [{"username": "demo", "user_role": "student", "institution_id": "inst-demo", "faculty_id": "fac-demo"}]),
    "document_types": ("name", [{"name": "coursework", "display_name": "Курсовая работа", "is_active": True}]),
}
