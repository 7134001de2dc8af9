"""Words and patterns of the Korean review rules.  They must be these for results to agree; the order is that of the rules."""

from __future__ import annotations

# Parts of words that are complaints.
NEGATIVE = (
    "불친절", "불편", "불만", "불쾌", "불량", "불안(?!전)", "불결",
    "비싸", "비싼", "비쌌", "비싸요", "비쌉니다",
    r"안\s*좋", "안되", r"안\s*돼", "안나",
    "없어[요서]", "없었", "없다", "없음", "없는", "없고",
    "늦", "느리", "더럽", "더러움", "더러웠", "더러워", "드러웠", "드러워", "지저분", "낡", "오래된", "오래됐", "노후", "좁은", "좁아", "멀어", "멀었",
    "나쁘", "나빠", "나쁜", "싫", "실망", "후회", "최악", "별로", "아쉬", "아쉽", "부족", "힘들", "어려", "고장", "냄새", "시끄", "답답", "짜증", "화[가났]",
    "오래걸", r"오래\s*걸", "기다[려렸]", "오래.{0,5}기다", "기다림.{0,5}힘", "기다림.{0,5}불편", "배차.{0,5}늦", "배차.{0,5}지연", "한참.{0,5}기다",
    "어이없", "어처구니없", "쓸데없",
    "스크래치", "얼룩", "마모", "미흡", "담배", "쩔어", "심하", "심했", "흠집", "찍힘", "긁힘", "파손", "오염", "먼지", "이물", "악취", "퀴퀴", "꿉꿉", "눅눅", "텁텁", "덜덜",
    "이상해", "이상하", "이상한",
    "바가지", "과금", "추가요금", "추가비용", "손해", "호구", "호갱", "이해.{0,3}안", "납득.{0,3}안",
    "무시", "무성의", "무책임", "퉁명", "불성실", "불신", "거짓", "사기", "먹튀", "기분.{0,5}안", "기분.{0,5}나빠", "복잡",
    r"지\s*않", r"지\s*못", r"못\s*하", r"(?:^|[^가-힣])안\s*하", r"좋지\s*않", "도.{0,3}안되", "도.{0,3}없",
)

# Words that are complaints by themselves.
STRONG_NEGATIVE = ("불친절", "불편하", "불쾌", "불량", "불만족", "비싸", "비싼", "비쌌", "비싸요", "비쌉", "최악", "실망", "후회", "무례", "무시", "무성의", "무책임")

# What looks like a complaint and is none.
EXCEPTIONS = (
    "틀림없", "끄떡없", "변함없", "다름없", "거침없", "막힘없", "흠잡을데없", "나무랄데없", "부족함없", "손색없", "어김없", "탈없", "걱정없", "부담없", "문제없",
    "번화가", "불쾌지수", "편안", "불안전", "만안", "생각하지 못한", "생각지 못한", "상상하지 못한", "기대하지 못한",
)

# Negations of complaints.
DOUBLE_NEGATION = (
    "불편.{0,10}없", "불만.{0,10}없", "문제.{0,10}없", "걱정.{0,10}없", "부족.{0,10}없", "부족함.{0,10}없", "아쉬.{0,10}없", "흠.{0,10}없", "탈.{0,10}없", "냄새.{0,10}없",
    "냄새.{0,10}안.{0,3}나", "냄새.{0,5}나지.{0,5}않", "하나도.{0,5}없", "하나도.{0,5}안", "전혀.{0,5}없", "전혀.{0,5}안", "별로.{0,5}없",
    r"부족함\s*없이", r"불편함\s*없이", r"문제\s*없이", r"탈\s*없이", r"걱정\s*없이", r"부담\s*없이", "불편.{0,10}못", "불만.{0,10}못", "문제.{0,10}못",
    "나쁘지.{0,5}않", "불편하지.{0,5}않", "느리지.{0,5}않", "비싸지.{0,5}않", "더럽지.{0,5}않", "좁지.{0,5}않", "늦지.{0,5}않", "멀지.{0,5}않", "힘들지.{0,5}않", "어렵지.{0,5}않",
    "별다른.{0,10}없", r"없지\s*않", "그다지.{0,5}나쁘지.{0,5}않",
    "나쁜.{0,5}(?:점|것).{0,5}없", "불편한.{0,5}(?:점|것).{0,5}없", "아쉬운.{0,5}(?:점|것).{0,5}없", "부족한.{0,5}(?:점|것).{0,5}없", "부담.{0,10}없", "부담.{0,10}안",
    "기다리지.{0,5}않", "기다림.{0,5}없", "대기.{0,5}없이",
)

# Parts of words that are praise.
POSITIVE = (
    "친절", "상냥", "정성", "배려", "감사", "고마", "칭찬", "추천", "최고", "좋았", "좋아요", "좋은", "좋습", "훌륭", "완벽", "만족", "편안", "편리", "편해", "편하", "쾌적",
    "빠른", "빠르", "빨랐", "빨리", "신속",
    "깨끗", "청결", "깔끔", "새차", "신차", "넓은", "넓어", "관리.{0,3}(?:잘|좋|됨|된)", "정비.{0,3}(?:잘|좋|됨|된)",
    "저렴", "싸다", "싸요", "싼", "합리", "가성비", "착한", "할인", "혜택", "가까", "접근", "찾기쉬", "강추",
    "기다려.{0,3}주", "바로.{0,5}배차", "빠른.{0,5}배차",
    "감동", "인상적", "기대.{0,3}(?:이상|만큼|보다|대로)", "재방문", "재이용", "또.*이용", "다시.*이용", "잘해", "잘하", "잘됐", "잘된", "괜찮", "무난", "문제없", "이상없", "덕분",
    "수월", "순조", "원활", "매끄럽", "매끄러", "안심", "업그레이드", "해주셨", "해주시", "해줬", "프로페셔널", "전문적",
)

# Praise that belongs to no aspect.
GENERAL_POSITIVE = ("좋", "만족", "굿", "good", "최고", "훌륭", "완벽", "추천", "강추", "최곱", "짱", "좋아", "좋아요", "좋았", "좋은", "좋네", "좋습", "만족해", "만족스러", "굿굿", "nice", "great", "best", "베스트")

# A worry that didn't come true.
CONCESSION = (
    "걱정.{0,15}(?:괜한|괜찮|기우)",
    r"(?:걱정|불안|우려).{0,5}(?:했는데|했지만|이었는데|이었지만).{0,15}(?:좋|괜찮|만족|깨끗|친절|감사|최고|잘|편|깔끔|문제\s*없)",
    "혹시.{0,20}(?:걱정|불안).{0,15}(?:괜찮|좋|만족|괜한|기우)",
    r"혹시.{0,25}(?:봐|싶어).{0,15}(?:괜찮|좋|만족|문제\s*없|괜한)",
)

# Praise denied, praise missing, complaints missing.
NEGATED_POSITIVE = (r"친절.{0,6}(?:지\s*않|지\s*못|하지\s*않)", r"깨끗.{0,6}(?:지\s*않|하지\s*않)", r"좋.{0,6}(?:지\s*않|지\s*못)", r"편.{0,6}(?:지\s*않|하지\s*않)")
MISSING_POSITIVE = ("친절.{0,5}없", "설명.{0,5}없", "안내.{0,5}없", "배려.{0,5}없")
ABSENT_NEGATIVE = ("불편", "불만", "문제", "걱정", "아쉬", "냄새", "흠", "나쁜", "부담", "탈", "고장", "실망", "불안", "위험", "부족", "어려", "힘들")

# Praise in short texts.
CLEAR_POSITIVE = ("최고", "최곱", "좋았", "좋아요", "좋네요", "좋습니다", "만족", "완벽", "훌륭", "추천", "감사", "고마워")
WELL_USED = ("이용", "사용", "됐", "됐어")

# Words and their weight where no pattern matches.
STRONG_HINTS = {"최고": 0.85, "최곱": 0.85, "완벽": 0.85, "훌륭": 0.85, "만족": 0.75, "추천": 0.75, "강추": 0.85, "감사": 0.7, "고마": 0.7}
MEDIUM_HINTS = {"좋았": 0.7, "좋아요": 0.7, "좋습": 0.7, "좋은": 0.65, "좋": 0.6, "잘": 0.6, "편": 0.55, "깔끔": 0.65, "빠": 0.55, "넓": 0.55}
WEAK_HINTS = ("요", "네요", "습니다", "^^", "~", "!", "ㅎㅎ", "ㅋㅋ")
WEAK_NEGATIVE = ("...", ";;;", "ㅜ", "ㅠ", "근데", "다만", "불")

# Within a window around a keyword.
NEGATION = r"지\s*않|지\s*못|못\s*하|(?<![가-힣])안\s*하|안\s*좋|너무\s*안"
ADVERSATIVE = "지만|는데|런데|다만|그렇지만|반면에?|대신|그래도|오히려"
NEGATING_PREFIXES = ("불", "비", "무", "몰")

# Keywords that name an aspect only beside words of its field.
IN_CONTEXT = (
    ("늦", "배달/배차", ("배차", "차량", "픽업", "도착", "출발", "시간", "대기", "기다")),
    ("빨리", "배달/배차", ("배차", "차량", "픽업", "처리", "배달", "대기", "응대")),
    ("빠르", "배달/배차", ("배차", "차량", "픽업", "처리", "배달", "대기", "응대")),
    ("빨랐", "배달/배차", ("배차", "차량", "픽업", "처리", "배달", "대기")),
    ("안심", "사고 처리", ("보험", "사고", "면책", "자차", "커버", "보장", "보상")),
    ("처리", "사고 처리", ("사고", "보험", "면책", "접수", "파손", "충돌", "수리")),
    ("접수", "사고 처리", ("사고", "보험", "면책", "파손", "충돌")),
    ("책임", "사고 처리", ("보험", "사고", "면책", "보장", "보상", "배상")),
)

# Where clauses end.
CONJUNCTIONS = ("그리고", "하지만", "그런데", "그래서", "또한", "그러나", "그렇지만", "그러므로", "따라서", "반면", "대신", "다만", "또", "게다가", "더구나", "뿐만아니라", "아울러")
ENDINGS = ("고", "지만", "는데", "은데", "한데", "른데", "어서", "아서", "면서", "니까", "며", "ㄴ데", "으며")

# Old names of categories; abuse and advertising; brands before model names.
LEGACY_CATEGORIES = {"직원이 친절함": "직원친절", "차량외관이 좋음": "외관", "가격이 저렴함": "가격", "차량이 청결함": "청결", "사고 처리를 잘해줌": "사고 처리", "주유비 부담 없음": "주유비", "배달 서비스가 우수함": "배달/배차", "배달": "배달/배차"}
PROFANITY = ("씨발", "시발", "ㅅㅂ", "ㅆㅂ", "병신", "ㅂㅅ", "지랄", "ㅈㄹ", "개새끼", "새끼", "ㅅㄲ", "미친", "또라이", "멍청", "바보", "꺼져", "닥쳐", "죽어", "뒤져", "썩어", "고소", "신고")
ADVERTISING = ("연락주세요", "문의주세요", "카톡", "카카오톡", "kakao", "010-", "02-", "070-", "http", "www.", ".com", ".kr", "할인", "이벤트", "무료", "선착순", "홍보", "광고")
BRANDS = (("BMWBMW", "BMW"), ("BMW", "BMW"), ("벤츠", "벤츠"), ("아우디아우디", "아우디"), ("아우디", "아우디"), ("현대", "현대"), ("기아", "기아"), ("쉐보레", "쉐보레"), ("르노", "르노"), ("쌍용", "쌍용"))
