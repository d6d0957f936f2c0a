"""All thresholds in one frozen object, so that tests and other data sets can scale them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from decimal import Decimal

HOUR, DAY = 3600, 86400
D = Decimal


@dataclass(frozen=True)
class Config:
    # Fixed values of the detection rules: seconds, shares as exact decimals, counts.
    circle_window: int = 72 * HOUR
    circle_low: Decimal = D("0.85")
    circle_high: Decimal = D("1.00")
    circle_min_hops: int = 3
    circle_max_hops: int = 8
    spray_receivers: int = 8
    spray_receivers_watch: int = 4
    spray_window: int = 6 * HOUR
    spray_share: Decimal = D("0.60")
    spray_low: Decimal = D("0.90")
    spray_high: Decimal = D("1.00")
    spray_delay: int = HOUR
    speed_link: int = HOUR
    speed_low: Decimal = D("0.90")
    speed_high: Decimal = D("1.00")
    speed_hops: int = 3
    speed_hops_watch: int = 2
    threshold_limits: tuple[int, ...] = (1_000_000, 50_000)
    threshold_channel: str = "CASH"
    threshold_low: Decimal = D("0.90")
    threshold_count: int = 5
    threshold_count_watch: int = 3
    threshold_window: int = 7 * DAY
    signal_first_amount: Decimal = D("100000")
    signal_new_days: int = 30
    signal_baseline: int = 15 * DAY
    dormant_age: int = 365
    dormant_gap: int = 15 * DAY
    dormant_max_before: int = 2
    dormant_burst: int = 48 * HOUR
    dormant_txns: int = 4
    dormant_txns_watch: int = 3
    dormant_amount: Decimal = D("500000")
    dormant_amount_watch: Decimal = D("200000")
    pass_window: int = 30 * 60
    pass_low: Decimal = D("0.85")
    pass_high: Decimal = D("1.00")
    pass_pairs: int = 4
    pass_pairs_watch: int = 3
    round_multiple: Decimal = D("50000")
    round_cluster: int = 3
    round_cluster_watch: int = 2
    round_window: int = 7 * DAY
    payroll_counterparties: int = 5
    payroll_ratio: Decimal = D("0.80")
    band_edges: tuple[int, ...] = (10_000, 100_000, 500_000, 1_000_000, 5_000_000)
    name_green: float = 0.85
    name_yellow: float = 0.75
    support_pad: int = 24 * HOUR
    context_pad: int = 48 * HOUR
    context_top: int = 3
    points_per_detector: int = 2
    amount_tiers: tuple[tuple[int, int], ...] = ((10_000_000, 3), (1_000_000, 2), (100_000, 1))
    high_score: int = 6
    medium_score: int = 4
    fresh_days: int = 30
    fresh_multiple: int = 10
    control_multiple: int = 2
    contact_multiple: Decimal = D("1.5")
    lens_min_count: int = 2
    control_groups: int = 20
    #: A walk or chain step that makes more rows than this fails loudly instead of dropping paths.
    most_paths: int = 50_000_000


#: Thresholds that fire on the synthetic `events` table, whose amounts stay below 500.
SCALED = replace(
    Config(),
    spray_receivers=4, spray_receivers_watch=3, spray_window=48 * HOUR, spray_share=D("0.25"), spray_low=D("0.50"), spray_delay=24 * HOUR,
    speed_link=6 * HOUR, threshold_limits=(100, 50), threshold_count=3, threshold_count_watch=2,
    signal_first_amount=D("100"), signal_baseline=12 * HOUR, dormant_gap=12 * HOUR, dormant_amount=D("200"), dormant_amount_watch=D("120"),
    pass_window=6 * HOUR, pass_pairs=3, pass_pairs_watch=2, round_multiple=D("1"), round_cluster=3, round_cluster_watch=2,
    band_edges=(10, 25, 50, 100, 200), amount_tiers=((500, 3), (200, 2), (100, 1)),
)
