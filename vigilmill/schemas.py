"""Declared schemas of raw and derived records (Spark DDL)."""

POST = "id string, author string, created_utc double, retrieved_on bigint, subreddit string, title string, selftext string, score bigint, num_comments bigint, link_flair_text string, url string"
COMMENT = "id string, author string, created_utc double, retrieved_on bigint, subreddit string, body string, link_id string, parent_id string, score bigint"
EXTRACTION_LOG = "log_line bigint, target_drugs array<string>, record_id string, user_id string, subreddit string, date_text string, status string, model_name string, extraction string, error_text string"
FIELDS = {"posts": [c.split()[0] for c in POST.split(", ")], "comments": [c.split()[0] for c in COMMENT.split(", ")]}
EXPOSURE_COLUMNS = {"user_id", "exposure_group", "group_type", "n_target_drugs", "record_id"}
EVENT_COLUMNS = {"user_id", "exposure_group", "meddra_pt_zh", "validated_meddra_pt", "proposed_meddra_pt"}
