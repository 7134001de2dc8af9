"""Regions and kinds of branches by name.  The lists must be these for results to agree; every function takes others as parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, first_containing

# Words of airport and tourist branches.
AIRPORTS = ("공항", "인천공항", "김포공항", "제주공항", "김해공항", "대구공항")
TOURIST = ("제주", "부산", "강릉", "속초", "여수", "경주", "전주")
# Regions that a name may tell, in the order in which they are tried.
REGIONS = (
    "인천공항", "김포공항", "제주공항", "김해공항", "대구공항", "제주", "부산", "인천", "김포", "김해", "대구", "광주", "대전", "강릉", "속초", "여수", "경주", "전주", "강남", "서울", "경기",
)
# First word of a region -> group, and the order of groups.
GROUPS = {
    "서울": "서울", "경기": "경기도", "인천": "경기도", "강원": "강원도", "충남": "충청도", "충북": "충청도", "대전": "충청도", "세종": "충청도",
    "전남": "전라도", "전북": "전라도", "광주": "전라도", "경남": "경상도", "경북": "경상도", "부산": "경상도", "대구": "경상도", "울산": "경상도",
    "제주": "제주도", "해외": "해외",
    "김포공항": "서울", "강남": "서울", "인천공항": "경기도", "김포": "경기도", "강릉": "강원도", "속초": "강원도", "여수": "전라도", "전주": "전라도",
    "김해공항": "경상도", "김해": "경상도", "대구공항": "경상도", "경주": "경상도", "제주공항": "제주도",
}
GROUP_ORDER = ("서울", "경기도", "강원도", "충청도", "전라도", "경상도", "제주도", "해외")
#: The group of regions that no first word names.
ABROAD = "해외"


def kind(name: Column, airports: Sequence[str] = AIRPORTS, tourist: Sequence[str] = TOURIST) -> Column:
    """airport, tourist or city, the first that the name tells; default without a name."""
    return F.when(F.coalesce(name, F.lit("")) == "", "default").when(contains_any(name, airports), "airport").when(contains_any(name, tourist), "tourist").otherwise("city")


def group(region: Column, groups: Mapping[str, str] = GROUPS, other: str = ABROAD) -> Column:
    """The group of a region by its first word."""
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return F.coalesce(F.element_at(table, F.regexp_extract(region, r"(?U)^\s*(\S+)", 1)), F.lit(other))


def region_in(name: Column, regions: Sequence[str] = REGIONS) -> Column:
    """The first region of the list that the name holds; null if it holds none or there is no name."""
    return first_containing(name, regions)
