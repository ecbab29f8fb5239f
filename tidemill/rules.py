"""Rule packs: words, tables and patterns of the editing standard, as data.

White space is written W in patterns (it includes the ideographic and no-break spaces), other characters NW.
"""

from __future__ import annotations

W, NW = r"[\s\p{Z}]", r"[^\s\p{Z}]"


def spaced(pattern: str, merged: bool = False) -> str:
    """Expand \\s and \\S of a pattern to classes that Spark and other engines read alike. merged: for texts whose only white space is the space, which is quicker."""
    out, i, inside = [], 0, False
    space, within, other = (" ", " ", "[^ ]") if merged else (W, r"\s\p{Z}", NW)
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(within if inside else space)
            i += 2
        elif two == r"\S":
            out.append(other)
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[:1] == "[" or (inside and two[:1] != "]")
            out.append(two[:1])
            i += 1
    return "".join(out)


# ---- fixed values -------------------------------------------------------------------------------
# The following words, tables and patterns must equal the editing standard's for right results.

GROUPS = ["아파트", "연립주택/다세대/빌라", "단독주택,다가구주택", "상가/오피스텔,근린시설", "대지/임야/전답", "기타"]
OTHER, EXCLUDED = "기타", "게재제외"
#: W11: a list of numbers. A8: an item of what isn't registered: name, what lies between, amount, unit.
LISTED = r"(목록)(\d+(?:,\d+)+)"
UNREGISTERED = r"([가-힣·]+)(?:[^0-9㎡]|\d+층)*?(\d+(?:\.\d+)?)\s*(㎡|식|주)"
EDITABLE = ["case_no", "dup_tag", "item_no", "price", "min_price", "note", "locations"]

PROVINCES = [
    "서울특별시", "부산광역시", "대구광역시", "인천광역시", "광주광역시",
    "대전광역시", "울산광역시",
    "경기도", "강원도", "강원특별자치도",
    "충청북도", "충청남도",
    "전라북도", "전북특별자치도", "전라남도",
    "경상북도", "경상남도",
    "제주특별자치도", "제주도",
]
SEJONG = "세종특별자치시"

MATERIALS = [
    r"\[철근\]\s*콘크리트",
    r"\(철근\)\s*콘크리트",
    r"철근\s*콘크리트",
    r"철근콘크리트구조",
    r"철근콘크리트조",
    r"철근\s*콘크리트조",
    r"철근\s*콘크리트구조",
    r"철근콘크리트 벽식구조",
    r"철근콘크리트평지붕",
    r"철근콘크리트평슬래브",
    r"\(철근\)콘크리트지붕",
    r"일반철골구조지붕",
    r"일반철골구조",
    r"경량철골구조",
    r"경량철골조",
    r"철골구조위 칼라강판지붕",
    r"철골구조",
    r"벽돌조 슬래브지붕",
    r"벽돌및\s*시멘트\s*벽돌조\s*슬래브지",
    r"시멘트\s*블럭조\s*슬래브지붕",
    r"시멘트블럭조\s*강판지붕",
    r"시멘트브럭조\s*슬래브지붕",
    r"시멘벽돌조 슬래브지붕",
    r"일반목구조\s*아스팔트슁글지붕",
    r"아스팔트슁글지붕",
    r"기타지붕\(패널\)",
    r"기타지붕\[패널\]",
    r"기타지붕\(아스팔트싱글\)",
    r"기타지붕",
    r"샌드위치패널지붕",
    r"샌드위치\s*판넬조",
    r"컬러강판지붕",
    r"칼라강판지붕",
    r"강파이프구조",
    r"연와조 평스라브지붕",
    r"평스라브지붕",
    r"슬래브지붕",
    r"판넬지붕",
    r"판넬조",
    r"조립식판넬지붕",
    r"조립식\s*판넬지붕",
    r"벽돌조",
]
MATERIAL_CLEANUP = [
    (r"(?:철근)?콘크리트\s*(?:평\s*)?슬래브\s*및?", ""),
    (r"철근\s*콘크리트\s*및?", ""),
    (r"철골\s*콘크리트\s*및?", ""),
    (r"및\s+및", "및"),
    (r"^\s*및\s+", ""),
    (r"\[\s*\]", ""),
    (r"\(\s*\)", ""),
    (r"\s{2,}", " "),
]
MATERIAL_STEMS = "콘크리트|철골|지붕|판넬조|벽돌조|강파이프구조|슬래브지|목구조"

FACILITY = [
    (r"[12]\s*,\s*[12]\s*종\s*근린생활시설", "근린시설"),
    (r"제?\s*[12]\s*종\s*근린생활시설", "근린시설"),
    (r"근린생활시설", "근린시설"),
]
FARMLAND = [
    (r"농지취득자격증명\s*원?\s*제출요", "농지취득자격증명요"),
    (r"농지취득자격증명\s*제출\s*필요", "농지취득자격증명요"),
    (r"농지취득자격증명\s*제출요", "농지취득자격증명요"),
    (r"\(매각결정기일\s*까지\s*미제출시[^)]*\)", ""),
    (r"\(미제출시[^)]*\)", ""),
    (r"농지법\s*제\s*8조\s*제1항\s*제1호에\s*따라\s*농지취득자격증명원\s*필요하지\s*않음", "농지취득증명원불요"),
]
PARTICLES = [
    (r"~바람($|[^\p{L}\p{N}_])", "요$1"),
    (r"임\s*\.?$", ""),
    (r"제출바람", "제출요"),
    (r"조경용으로조성된연못", "조경용조성연못"),
]

#: Share notation: pattern, replacement; what stands between <> in a replacement loses its spaces.
HOLDER = r"[가-힣A-Za-z㈜\(\)\s]+?"
SHARE_FORMS = [
    (r"\(?\s*(갑구\s*\d+(?:-\d+)?번)\s*공유자\s+([가-힣A-Za-z0-9㈜\(\)\s]+?)\s+지분\s+(\d+(?:\.\d+)?)\s*분의\s*(\d+(?:\.\d+)?)\s+전부\s*\)?", "<$1>공유자<$2>$4/$3지분전부"),
    (rf"\(?\s*소유자\s+({HOLDER})\s+지분\s+중?\s*일부\s*\(?\s*(\d+)\s*분의\s*(\d+)\s*\)?\s*\)?", "$1$3/$2지분일부"),
    (rf"\(?\s*소유자\s+({HOLDER})\s+지분\s+일부\s+(\d+)\s*분의\s*(\d+)\s*\)?", "$1$3/$2지분일부"),
    (rf"\(?\s*공유자\s+({HOLDER})\s+지분\s+(\d+)\s*분의\s*(\d+)\s+전부\s*\)?", "<$1>$3/$2지분전부"),
    (rf"\(?\s*({HOLDER})\s+지분\s+전부\s+(\d+)\s*분의\s*(\d+)\s*\)?", "<$1>$3/$2지분전부"),
    (rf"\(?\s*채무자\s+({HOLDER})\s+지분\s+(\d+)\s*분의\s*(\d+)\s+전부\s*\)?", "<$1>$3/$2지분전부"),
]
#: A share clause in standard order, and one named by its owner; spaces go afterwards.
SHARE_CLAUSES = [
    (r"(갑구\s*\d+(?:-\d+)?번)\s*([가-힣A-Za-z0-9㈜\(\)\.\-·\s]+?)\s*(\d+(?:\.\d+)?)\s*분의\s*(\d+(?:\.\d+)?)\s*지분\s*(전부|일부)?", "$1$2$4/$3지분$5"),
    (r"(공유자|소유자|채무자)\s*([가-힣A-Za-z0-9㈜\(\)\.\-·\s]+?)\s*(?:지분\s*중?\s*)?(\d+(?:\.\d+)?)\s*분의\s*(\d+(?:\.\d+)?)\s*지분\s*(전부|일부)?", "$2$4/$3지분$5"),
]
SHARE_WORDS = ["지분", "갑구", "공유자", "소유권", "을구", "채무자"]
SHARE_GROUP = r"\(([^()]*(?:지분|갑구|공유자|소유권|채무자)[^()]*)\)"
SHARE_MARKERS = ["[", "갑구", "공유자", "소유자", "채무자", "소유권"]
MATCH_MARKERS = ["(", "[", "갑구", "공유자", "소유자", "채무자", "소유권"]
NOTE_GUARDS = ["일괄매각", "지분매각", "제시외", "목록", "유치권", "성립여부", "불분명", "농지취득자격증명", "토지별도등기", "공유자우선매수권", "매각물건명세서"]

LAND_USE = r"^(대|답|전|임야|도로|주유소용지|공장용지|체육용지|창고용지|기타)\s*(.*)$"
BUILDING_USE = r"^(\d+층\s*)?(아파트|오피스텔|연립주택|다가구주택|단독주택|근린시설|공장|창고|주택)"
USE_GROUPS = {
    "아파트": "아파트",
    "오피스텔": "오피스텔",
    "연립주택": "연립주택", "다세대주택": "연립주택",
    "다가구주택": "단독주택,다가구주택", "단독주택,다가구주택": "단독주택,다가구주택", "단독주택": "단독주택,다가구주택", "단독주택,\n다가구주택": "단독주택,다가구주택",
    "근린시설": "근린시설",
    "임야": "대지/임야/전답", "전답": "대지/임야/전답", "대지,임야,전답": "대지/임야/전답", "대지/임야/전답": "대지/임야/전답", "대지,임야,\n전답": "대지/임야/전답",
}
TEXT_USE = r"(아파트|오피스텔|연립주택|다세대주택|단독주택[,\s]*다가구주택|다가구주택|단독주택|근린시설|임야|전답|대지[,\s]*임야[,\s]*전답|공장|기타)"
TEXT_ADDRESS = "((?:서울특별시|부산광역시|대구광역시|인천광역시|광주광역시|대전광역시|울산광역시|세종특별자치시|경기도|강원도|강원특별자치도|충청북도|충청남도|전라북도|전북특별자치도|전라남도|경상북도|경상남도|제주특별자치도)[^\\n]+)"

CASE = r"\d{4}\s*타경\s*\d+"
LOT = r"(?:산)?\d+(?:-\d+)*"
FLOOR = r"(\d+)\s*층\s*(\d+(?:\.\d+)?)\s*㎡"
TOWN = r"^\s*(?:\S+시|\S+군)\s+(?:\S+[읍면동리]|\S+[로길])\s+"
TOWN_SEJONG = r"^\s*세종특별자치시\s+(?:\S+[읍면동리]|\S+[로길])\s+"
KEYWORD = "[가-힣A-Za-z0-9]{2,}"
STOPWORDS = ["사건", "물건", "매각", "포함", "있음", "없음", "기타", "일부", "전부", "단독", "공유", "공부", "현황", "이용", "주택"]
OFFICE = r"담\s*당\s*계\s*[:：]?\s*(경매\s*\d+\s*계(?:\s*\S+)?)"
SALE_DATE = r"매각일시\s*[:：]?\s*([^\n]+)"
DECISION_DATE = r"매각결정일시\s*[:：]?\s*([^\n]+)"
UNKNOWN_CASE = "미상"
FAILED = "[편집 실패]"

#: Keywords of the rule classifier.
VEHICLES = "차명|차대번호|등록번호|연식|차종|사용본거지|선박의종류|선명|어선번호|선질|총톤수|정박항|선적항|진수년월일"
CONDITIONS = "토지별도등기|지상수목포함매각"
FACTORIES = "공장|기계기구"
HOUSES, FLATS, ROWS, DETACHED = "주택|아파트|빌라", "아파트", "연립|다세대|빌라", "단독주택|다가구|주택"
SHOPS, LODGINGS, LANDS, FIELDS = "근린시설|근린생활시설|상가|오피스텔|점포|사무소", "숙박|여관|모텔|호텔", "대지|임야|전답|^대 |^답 |^전 |^임야 ", "^답 |^전 |전답"
# ---- end of fixed values ------------------------------------------------------------------------
