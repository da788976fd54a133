"""Table schemas of the engine."""

from __future__ import annotations

CRAWL_INDEX = (
    "url string, filename string, offset string, length string, status string, "
    "`mime-detected` string, encoding string, digest string"
)

SCAN = (
    "_id string, task struct<time:string,visibility:string>, "
    "page struct<url:string>, sort array<string>"
)

SCAN_PAGE = (
    "results array<struct<_id:string, task:struct<time:string,visibility:string>, "
    "page:struct<url:string>, sort:array<string>>>, total bigint, has_more boolean"
)

# one archive record read by byte range
ARCHIVE = "warc_date string, html string, error string"

# scalar columns of one document revision; the first capture of a key wins
SCALARS = [
    "created",
    "page_title",
    "og_title",
    "og_description",
    "og_image",
    "content",
    "links",
    "image_urls",
]

DOCUMENTS = (
    "id string, revision bigint, created string, page_title string, og_title string, "
    "og_description string, og_image string, content string, links array<string>, "
    "image_urls array<string>"
)

# one row per capture of a document revision; `ord` is unique within a batch
OBSERVATIONS = (
    "id string, revision bigint, og_title string, og_description string, "
    "src string, sid string, ts string, ord bigint"
)

# the first ten signs of the time, which sort as the times do; files are kept apart by it
DAY = "day string"

# observations of a day by source
DAYS = "day string, src string, n bigint"

PROCESSED = "digest string"

POSTINGS = "term string, col string, id string, revision bigint, positions array<int>"

# postings as files hold them, many documents of a word in a row: `first` is the least id of them,
# `n` their number, and `occurrences` says how often they have the word
BLOCKS = (
    "term string, col string, first string, n bigint, occurrences bigint, "
    "docs array<struct<id:string,revision:bigint,positions:array<int>>>"
)

# how many documents of a file of postings have a word, and how often they have it
TERMS = "term string, col string, file string, n bigint, occurrences bigint"

# ids of a file of documents: the first and last, how many rows, and a sketch of the distinct ones
PLACES = "file string, first string, last string, n bigint, ids binary"

# latest observation of the highest revision a batch saw of a document
LATEST = "id string, revision bigint, at timestamp"

REMOVED = "id string, revision bigint"

QUARANTINE = "origin string, key string, url string, status string, detail string"

# rows of a batch by status, those that were skipped among them
COUNTERS = "status string, n bigint"

KEY = ["id", "revision"]
