"""Schemas of the engine's tables, as DDL."""

BLOCKS = "doc string, page int, block_ord int, block_kind int, x0 double, y0 double, x1 double, y1 double, text string"
SPANS = "doc string, page int, block_ord int, line int, span int, text string, font string, size double, flags int"
GRIDS = "doc string, page int, finder int, table_ord int, cells array<array<string>>, x0 double, y0 double, x1 double, y1 double"
ELEMENTS = "doc_name string, ord int, page_number int, element_type string, content string, section string"
CHUNKS = "chunk_id string, parent_id string, doc_name string, page_number int, section_path string, element_type string, text string, raw_content string, token_count int, char_count int, ordinal int, is_split_table boolean, part int"
CATALOG = "ord int, doc_name string, title string, domain string, topics array<string>, entities array<string>, summary string"
REQUESTS = "request_id int, query string, force_workflow string, top_k int"
EVAL = "id string, expected_workflow string, actual_workflow string, should_abstain boolean, abstained boolean, verification_status string, latency double, errored boolean"
EVAL_DATASET = "id string, category string, expected_workflow string, question string, target_doc string, expected_concepts array<string>, should_abstain boolean"
ELEMENT_TYPES = ("heading", "paragraph", "table", "code", "list_item")
