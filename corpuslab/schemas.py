"""Schemas of the records that stages exchange."""

FILE_RECORDS = "volume_number int, issue_number int, publication_year int, publication_month int, raw_hash string, text string"
STORIES = "volume_number int, issue_number int, publication_year int, publication_month int, title string, authors array<string>, full_text string"
PARAGRAPHS = "volume_number int, issue_number int, publication_year int, publication_month int, title string, authors array<string>, story_id string, paragraph_id long, paragraph_index int, paragraph_text string"
TOPIC_ASSIGNMENTS = "paragraph_id long, topic_id int, probs array<double>"
TOPIC_KEYWORDS = "topic_id int, rank int, word string, score double"
PARAGRAPH_SPANS = "paragraph_id long, topic_id int, spans array<struct<start:int,end:int,text:string>>"
MASKED_PAIRS = "pair_id string, topic_id int, original string, masked string, mask_ratio double, length int"
INFILLED_PAIRS = MASKED_PAIRS + ", infilled string, infill_score double, sim_score double, hybrid_score double, sampling_strategy string, sampling_params map<string,double>"
FINAL_PAIRS = "sent1 string, sent2 string, pair string, score double"
VIS_POINTS = "x double, y double, topic int, probability double"
