"""Business constants. Every operator takes them as parameters with these defaults."""

from dataclasses import dataclass, field
from statistics import NormalDist

# They must equal the published business rules for results to agree.
HORIZONS = (("1-Month", 30), ("3-Month", 90), ("6-Month", 183))
WAREHOUSE_BY_CHANNEL = {
    "Web": "central_online_wh",
    "Offline": "central_offline_wh",
    "App": "central_online_wh",
    "Unknown": "main_wh",
}
DEFAULT_WAREHOUSE = "unknown_wh"
ABC_SHARES = {"A": 0.2, "B": 0.3}
SERVICE_LEVELS = {"A": 0.98, "B": 0.95, "C": 0.90}
PREDICTION_LENGTH = 183
QUANTILE_LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9)
VALIDATION_WINDOWS = 5
SMA_WINDOW = 7
SEASON_LENGTH = 7
TEST_DAYS = 7
MIN_SERIES_DAYS = 30
SPORADIC_THRESHOLD = 0.60
ENSEMBLE_WAPE_THRESHOLD = 50.0
MIN_SEASONAL_STRENGTH = 0.2
IMPROVEMENT_THRESHOLD = 0.02
VERSIONS_TO_KEEP = 5
RANDOM_SEED = 42
HOLIDAY_TYPES = ("National holiday", "Optional holiday")
CHANNEL_ORDER = ("App", "Web", "Offline")
WEDDING_MONTHS = (10, 11, 12, 1, 2)
DIWALI_MONTHS = (10, 11)
VALENTINE_MONTH = 2
FEEDBACK_SCORES = {
    "Forecast too high": -1.0,
    "Good forecast": 0.0,
    "Forecast too low": 1.0,
    "Stockout occurred": 1.5,
}
EXCLUDED_SKU_PREFIXES = ("GW", "GD", "FREE", "PX", "PM", "JO", "CA", "PR", "ID", "UT")
APP_SOURCES = ("5204949", "232217378817")
# The columns of the panel that are known ahead.
KNOWN_COVARIATES = (
    "was_stocked_out", "is_holiday", "is_on_promotion", "month", "day_of_week",
    "is_weekend", "is_wedding_season", "is_diwali_period", "is_valentine_month",
    "is_high_discount", "sales_ma_7", "sales_ma_14", "stockout_days_last_7",
    "potential_lost_sales", "gold_price_change", "gold_price_ma_7",
    "sales_lag_1", "sales_lag_7", "sales_lag_14", "sales_std_7", "sales_std_30",
    "feedback_score_30d_avg", "time_since_last_sale", "days_with_sales_last_7d",
)
UPLOAD_COLUMNS = ("sku", "timestamp", "target", "disc")

# Search of the tree model: (depth, learning rate) tried, most rounds, the least relative gain of a round on the
# validation days, and the rounds where a history is too short to validate.
GBT_GRID = ((3, 0.3), (5, 0.3))
GBT_MAX_ROUNDS = 200
GBT_TOLERANCE = 0.002
GBT_FEW_ROUNDS = 20


def z_score(service_level: float) -> float:
    """Standard normal quantile of a service level."""
    return NormalDist().inv_cdf(service_level)


@dataclass(frozen=True)
class StockPolicy:
    """Lead time, order size and costs behind safety stock, reorder point and EOQ."""

    lead_time_days: int = 40
    min_order_qty: float = 10.0
    ordering_cost: float = 10.0
    holding_cost: float = 20.0
    service_levels: dict = field(default_factory=lambda: dict(SERVICE_LEVELS))


@dataclass(frozen=True)
class PricedStockPolicy:
    """The variant whose costs are shares of the product price."""

    lead_time_days: int = 21
    min_order_qty: float = 20.0
    service_level: float = 0.95
    holding_share: float = 0.10
    ordering_share: float = 0.30
