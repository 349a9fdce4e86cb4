"""Explicit schemas of what is read; nothing is inferred."""

from __future__ import annotations

WEBMETA = (
    "url string, domain string, ts_collected double, "
    "rdap struct<domain:string,registry:string,domain_status:array<string>,events:map<string,string>,raw:string>, "
    "wayback struct<url:string,first_seen_ts:string,latest_seen_ts:string,snapshots:int,first_ts:string,last_ts:string,count:int>, "
    "http struct<url_requested:string,final_url:string,status_code:string,headers:map<string,string>,server:string,via:string,content_type:string,content_length:string,request_url:string,response_url:string>, "
    "tls struct<host:string,port:int,sni:string,issuer:string,subject:string,not_before:string,not_after:string,serial_number:string,sig_hash_alg:string,subject_alternative_names:array<string>>, "
    "errors array<string>"
)

POSTS = "posting_id string, platform string, post_id string, subreddit string, author_name string, created_utc double, score double, num_comments double, upvote_ratio double"

SNAPSHOTS = (
    "snapshot_utc double, posting_id string, post_id string, subreddit string, author string, created_utc double, score double, upvote_ratio double, "
    "num_comments double, total_awards_received double, view_count double, upvotes double, downvotes double"
)
