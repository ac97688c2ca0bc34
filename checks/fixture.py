"""Parameters shared by the registered queries and their SQL counterparts.

Class limits fit the amounts of the test tables; the library's defaults are
meant for smaller ones.
"""

import datetime as dt

LOAD_TS = dt.datetime(2024, 2, 1, 6, 30)
RUN_STARTED = dt.datetime(2024, 2, 1, 6, 0)
RUN_ID = "run-0001"
NEXT_LOAD_TS, NEXT_RUN_STARTED, NEXT_RUN_ID = dt.datetime(2024, 2, 2, 6, 30), dt.datetime(2024, 2, 2, 6, 0), "run-0002"
CORRECTED_TS = dt.datetime(2024, 2, 3, 6, 30)
AS_OF = dt.date(2024, 2, 1)

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
CUSTOMER_TIER = {"vip": (2_500_000, 12), "frequent": 10, "high_value": 1_500_000}
CUSTOMER_SEGMENT = {"total_over": 2_500_000, "count_over": 10}
LINE_SEGMENT = {"total_over": 2_500_000, "count_over": 45}
PRODUCT_TIER = {"star": (1_900_000, 33), "performer": 1_700_000, "popular": 33, "high_margin": 0.3}
VOLUME_STEPS = ((950, "High Volume"), (750, "Medium Volume"))
SIZE_STEPS = ((75_000, "Large"), (50_000, "Medium"), (10_000, "Small"))
DAILY_LIMITS = {"temperature": 8, "humidity": 50, "wind": 7.5, "precipitation": 240}
TRAILING_THRESHOLD = 1

COORDINATES = {"AMERICA": (45.0, -93.0), "ASIA": (30.0, -80.0)}
HIGH_PRIORITY = ("ECONOMY", "LARGE")
CATEGORY_GROUPS = {"ECONOMY": "Value", "PROMO": "Value", "STANDARD": "Regular", "SMALL": "Regular"}

EXTRACT_FROM = dt.date(2000, 1, 1)
ONE_DAY = dt.date(2024, 1, 15)
HALF_TIME = dt.datetime(2024, 1, 16, 12, 0)
FIRST_DAY, LAST_DAY = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
LOOKBACK_DAYS = 1460
ANOMALY_LIMIT = 100_000
BACKFILL_FROM = dt.date(2024, 1, 9)
RETAIN_DAYS, RETAIN_AS_OF = 365, dt.date(2001, 8, 1)
FIRST_LOAD_UNTIL = dt.date(2000, 7, 1)
BATCH_FROM = dt.date(2000, 1, 1)
REFRESH_YEAR = 1999
EXPIRE_DAYS, EXPIRE_AS_OF = 10, dt.date(2024, 1, 20)
SALES_THRESHOLD = 50_000
KNOWN_BEFORE = dt.date(1995, 7, 1)
