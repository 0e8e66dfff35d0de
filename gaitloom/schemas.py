"""Declared schemas of every input; nothing is inferred."""

INDEX = "dataset string, motion_id string, source_motion string, caption_file string, captions array<string>, description string, object_id string, cache_glb string, frame_count int"
CASES = "id string, query string, language string, query_type string, split string, relevant_asset_ids array<string>, relevant_motion_patterns array<string>, forbidden_asset_ids array<string>, forbidden_motion_patterns array<string>, relevant_total int"
CAPTIONS = "object_id string, caption string, caption_rank int, dataset string, source_type string, embedding array<float>"
NODE = "struct<id string, parent_id string, kind string, zh_cn string, en string, aliases_en array<string>, aliases_zh array<string>, summary string, focus string, source_refs array<string>, legacy_category string, legacy_tag string, asset_taxonomy boolean, legacy_only boolean, allow_depth boolean, priority int>"
CATALOG = f"schema_version int, taxonomy_version string, default_max_depth int, nodes array<{NODE}>"
SOURCE_TREE = "taxonomy array<struct<major string, summary string, groups array<struct<name string, focus string, tags array<string>>>>>"
SOURCES = "schema_version int, retrieved_at string, sources array<struct<id string, title string, publisher string, version string, url string, license string, usage string>>"
CLASSIFICATION = "struct<taxonomy_version string, taxonomy map<string,string>, taxonomy_labels map<string,string>, primary_action_node_id string, action_nodes array<struct<id string, label string, en string, kind string, path array<string>, role string, matched_phrases array<string>, source_refs array<string>>>, matched_keywords map<string,array<string>>, classification_confidence double, classification_method string, confidence_level string, rule_conflict boolean, classification_model struct<name string, score double, leaf_score double, prototype_score double, group_score double, major_score double, margin double, candidate_node_ids array<string>, matched_caption string, confidence_level string, status string>>"
ASSIGNMENTS = f"object_id string, classification {CLASSIFICATION}"
