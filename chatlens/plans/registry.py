"""All registered queries and their SQL restatements."""

from chatlens.plans import message_queries, topic_queries, topic_sql

QUERIES = {**message_queries.QUERIES, **topic_queries.QUERIES}
ORACLE = {**message_queries.ORACLE, **topic_sql.ORACLE}
