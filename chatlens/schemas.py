"""Column contracts of the tables read and written."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW_EXPORT = _table(session_id=_S, Question=_S, Category=_S, Response=_S, translated_answer=_S,
                    cal_role=_S, cal_state=_S, cal_feedback=_S)
MESSAGES_CLEANED = _table(datetime=_TS, whatsapp_id=_S, user_msg=_S, user_msg_category=_S, ai_msg=_S,
                          ai_msg_en=_S, cal_state=_S, cal_feedback=_S)
ROLE_LONG = _table(row_index=_L, role=_S, datetime=_TS, whatsapp_id=_S, text=_S)
SENTIMENT_MESSAGES = _table(role=_S, whatsapp_id=_S, datetime=_TS, message=_S, sentiment_label=_S,
                            sentiment_score=_D, sentiment_stars=_I)
AGENCY_MESSAGES = _table(message_id=_S, row_index=_L, message_role=_S, datetime=_TS, whatsapp_id=_S,
                         text_original=_S, text_translated=_S, agency_score=_D, is_high=_B, is_low=_B)
CAL_STATE_BY_USER = _table(whatsapp_id=_S, cal_state=_S, message_count=_L)
TOPIC_KEYWORDS = _table(message_role=_S, topic_id=_I, intent_label=_S, keywords=_S, message_count=_L)
DATETIME_OVERVIEW = T.StructType([
    T.StructField("total_messages", _L), T.StructField("unique_users", _L),
    T.StructField("start_datetime", _S), T.StructField("end_datetime", _S), T.StructField("total_days", _I),
    T.StructField("messages_by_date", T.ArrayType(_table(date=_S, messages=_L))),
])
TRANSLATION_RESULT = _table(text_en=_S, input_tokens=_L, output_tokens=_L, failed=_B)
