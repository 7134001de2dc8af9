"""Schemas of the review tables."""

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_RATING = T.DecimalType(2, 1)
_POLARITY = _struct(positive=T.ArrayType(_S), negative=T.ArrayType(_S), neutral=T.ArrayType(_S))

LAKE_REVIEW = _struct(**dict.fromkeys("review_id reservation_id branch_id company_name branch_name rating_service rating_car rating_convenience content review_date status car_type car_model rent_type rental_date return_date helpful_count".split(), _S))
BRANCH_REVIEWS = _struct(
    review_id=_L, reservation_id=_S, branch_id=_L, branch_name=_S, company_name=_S, content=_S, rating_service=_RATING, rating_car=_RATING, rating_convenience=_RATING,
    review_date=_TS, rental_date=_TS, return_date=_TS, car_model=_S, rent_type=_S, sentiment=_S, is_new=_B, created_at=_TS, updated_at=_TS, deleted_at=_TS,
)
REVIEW_TAG_MAPPINGS = _struct(review_id=_L, tag_id=_L, sentiment=_S, confidence=_D, source=_S, matched_keyword=_S)
TAGS = _struct(id=_L, name=_S, category_id=_L, is_active=_B, tag_type=_S)
CATEGORIES = _struct(id=_L, name=_S, display_order=_I, color=_S, is_active=_B)
BRANCH_TAGS = _struct(branch_id=_L, tag_id=_L, period_type=_S, count=_L, positive_count=_L, negative_count=_L, neutral_count=_L, weighted_score=_D, rank=_I)
BRANCH_KEYWORDS = _struct(branch_id=_L, keyword=_S, count=_L, last_seen_at=_TS)
BRANCH_SUMMARIES = _struct(
    branch_id=_L, branch_name=_S, region=_S, review_count=_L, avg_rating=T.DecimalType(3, 2), keywords=T.ArrayType(_S),
    summary_1m=_S, summary_3m=_S, summary_6m=_S, summary_1y=_S, summary_all=_S, pending_summaries=T.MapType(_S, _S),
)
TAG_SENTIMENTS = T.MapType(_S, _POLARITY)
