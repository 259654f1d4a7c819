"""Schemas and constants of the paper model."""

from __future__ import annotations

PAPERS = "paper_id bigint, title string, abstract string, category string, primary_category string, authors string, published string, updated string, url string"
FEED_ENTRY = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>, `arxiv:primary_category` struct<_term:string>"
QUESTION = "id string, question string, topic string, question_type string, difficulty string, gold_papers array<string>, gold_chunks array<string>, reference_answer string, keywords array<string>, requires_multi_hop boolean, answer_style string, notes string"
CHUNK = "paper_id string, chunk_id string, chunk_index int, chunk_text string, section_title string, section_path string, page_start int, page_end int, char_start bigint, char_end bigint, title string, authors string, category string, published string, url string, arxiv_id string, topic_cluster string, token_count int, word_count int, contains_citation_marker boolean, contains_equation_like_text boolean"

# Category prefix, palette, enumerations and sizes of the paper model.
PREFIX = "astro-ph."
CATEGORIES = ("astro-ph.GA", "astro-ph.SR", "astro-ph.HE", "astro-ph.CO", "astro-ph.EP", "astro-ph.IM")
COLORS = {"astro-ph.GA": "#5ab3ff", "astro-ph.SR": "#ff8a3d", "astro-ph.HE": "#3ddc97", "astro-ph.CO": "#ff5d73", "astro-ph.EP": "#b57cff", "astro-ph.IM": "#f4b942"}
DEFAULT_COLOR = "#94a3b8"
QUESTION_TYPES = ("definition", "mechanism", "comparison", "challenge", "method", "result", "interpretation")
DIFFICULTIES = ("easy", "medium", "hard")
TOP_K, RECOMMENDATIONS, RESULT_LIMIT = 5, 8, 40
TEST_SHARE, SEED = 0.25, 42
UMAP_NEIGHBOURS, UMAP_MIN_DIST = 12, 0.08
