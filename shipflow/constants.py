"""Domain values shared by the operators."""

# Status order; event_sequence is the position, counted from 1.
STATUSES = (
    "CREATED",
    "ASSIGNED",
    "PICKUP",
    "IN_TRANSIT",
    "ARRIVED_HUB",
    "OUT_FOR_DELIVERY",
    "DELIVERED",
)

# region_id, region_name, region_group.
REGIONS = (
    ("REG_01", "서울", "수도권"),
    ("REG_02", "경기", "수도권"),
    ("REG_03", "인천", "수도권"),
    ("REG_04", "부산", "영남권"),
    ("REG_05", "대구", "영남권"),
    ("REG_06", "대전", "충청권"),
    ("REG_07", "광주", "호남권"),
    ("REG_08", "울산", "영남권"),
    ("REG_09", "강원", "강원권"),
    ("REG_10", "제주", "제주권"),
)

# hub_id, hub_name, region_id, latitude, longitude, hub_type.
HUBS = (
    ("HUB_001", "서울 동부 물류센터", "REG_01", 37.5665, 127.0500, "MAIN"),
    ("HUB_002", "서울 서부 물류센터", "REG_01", 37.5560, 126.9100, "SUB"),
    ("HUB_003", "경기 남부 물류허브", "REG_02", 37.2636, 127.0286, "MAIN"),
    ("HUB_004", "경기 북부 물류허브", "REG_02", 37.7380, 127.0450, "SUB"),
    ("HUB_005", "인천 항만 물류센터", "REG_03", 37.4563, 126.7052, "PORT"),
    ("HUB_006", "부산 항만 물류센터", "REG_04", 35.1796, 129.0756, "PORT"),
    ("HUB_007", "대구 내륙 물류센터", "REG_05", 35.8714, 128.6014, "MAIN"),
    ("HUB_008", "대전 중앙 물류센터", "REG_06", 36.3504, 127.3845, "MAIN"),
    ("HUB_009", "광주 호남 물류센터", "REG_07", 35.1595, 126.8526, "MAIN"),
    ("HUB_010", "울산 산업 물류센터", "REG_08", 35.5384, 129.3114, "INDUSTRIAL"),
    ("HUB_011", "강원 권역 물류센터", "REG_09", 37.8854, 127.7298, "SUB"),
    ("HUB_012", "제주 물류센터", "REG_10", 33.4996, 126.5312, "ISLAND"),
)

# Central hub of the region.
CENTRAL_HUBS = {
    "REG_01": "HUB_001",
    "REG_02": "HUB_003",
    "REG_03": "HUB_005",
    "REG_04": "HUB_006",
    "REG_05": "HUB_007",
    "REG_06": "HUB_008",
    "REG_07": "HUB_009",
    "REG_08": "HUB_010",
    "REG_09": "HUB_011",
    "REG_10": "HUB_012",
}

# Delay weight of the region.
REGION_WEIGHTS = {
    "REG_01": 0.78,
    "REG_02": 0.88,
    "REG_03": 0.95,
    "REG_04": 1.05,
    "REG_05": 1.00,
    "REG_06": 0.96,
    "REG_07": 1.08,
    "REG_08": 1.18,
    "REG_09": 1.35,
    "REG_10": 1.55,
}

# Delay weight of the hub.
HUB_WEIGHTS = {
    "HUB_001": 0.75,
    "HUB_002": 0.82,
    "HUB_003": 0.88,
    "HUB_004": 0.95,
    "HUB_005": 1.05,
    "HUB_006": 1.12,
    "HUB_007": 1.00,
    "HUB_008": 0.95,
    "HUB_009": 1.08,
    "HUB_010": 1.28,
    "HUB_011": 1.42,
    "HUB_012": 1.65,
}

# Lane weight inside a region, into two remote regions, otherwise.
LANE_WEIGHT_SAME_REGION = 0.88
LANE_WEIGHT_INTO = {"REG_10": 1.25, "REG_09": 1.15}
LANE_WEIGHT_OTHER = 1.08

# Fixed values: (MEDIUM from, HIGH from) for events and for the reference file.
EVENT_RISK_BANDS = (0.38, 0.70)
REFERENCE_RISK_BANDS = (0.40, 0.70)

# An event counts as delayed from here on.
DELAYED_FROM_PROBABILITY = 0.5
DELAYED_FROM_ETA_MINUTES = 30

# Severity of a risk label, for "worst" as opposed to the lexicographic maximum.
RISK_SEVERITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
