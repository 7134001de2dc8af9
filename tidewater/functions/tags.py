"""Categories of review tags, their groups, and the endings that a stem loses.  They must be these for results to agree.

The keywords of a tag are data: a registry is a table of category, tag, keyword and position (see ``operators.tagging``).
"""

from __future__ import annotations

# Category -> (group, default tag, tags in order).
CATEGORIES = {
    "직원친절": ("affiliate", "서비스", ("친절", "안내", "설명", "서비스", "고객응대", "응대속도", "전화응대", "예약")),
    "외관": ("vehicle", "차량외관", ("외관", "차량외관", "신차", "연식", "성능", "옵션", "차종", "내비게이션", "블랙박스")),
    "가격": ("affiliate", "가격", ("가격", "가성비", "할인", "요금", "추가요금", "정산", "면책금", "보험료")),
    "청결": ("vehicle", "청결", ("청결", "차량청결", "세차", "냄새", "실내", "시트", "트렁크")),
    "사고 처리": ("affiliate", "보험/보장", ("보험/보장", "면책", "사고처리", "수리", "보상", "긴급출동", "대차")),
    "주유비": ("affiliate", "주유", ("주유", "연비", "충전", "전기차", "만탄")),
    "배달/배차": ("affiliate", "딜리버리", ("딜리버리", "배차/시간", "대기시간", "탁송")),
    "반납/픽업": ("affiliate", "반납/픽업", ("반납/픽업",)),
    "위치/접근성": ("affiliate", "위치/접근성", ("위치/접근성", "공항", "주차장")),
}
# Endings of a word, longest first; the first one that leaves a character goes.
SUFFIXES = ("했습니다", "합니다", "합니까", "했다", "하다", "하게", "하고", "하는", "하면", "해서", "해요", "했어", "한", "함", "히", "적", "은", "는", "이", "가", "을", "를", "된", "에")
#: The tag that is left out of statistics.
OTHER = "기타"
