"""What detectors compare with. Every detector takes a Thresholds; none has numbers of its own."""

from __future__ import annotations

from dataclasses import dataclass

#: Identifiers that stand for "unknown" and are no person or place.
NO_CUSTOMER, NO_STORE, NO_SALESPERSON = "SEM_CADASTRO", "LOJA_NAO_IDENTIFICADA", "VENDEDOR_NAO_IDENTIFICADO"
PLACEHOLDERS = (NO_CUSTOMER, NO_STORE, NO_SALESPERSON)
DAYS_PER_MONTH = 30.44


@dataclass(frozen=True)
class Thresholds:
    leak_sigma: float = 2.0
    churn_cadence: float = 2.0
    churn_purchases: int = 3
    churn_silent_months: int = 3
    decoupling_pct: float = 20.0
    season_months: int = 12
    materiality_pct: float = 1.0
    rfm_bins: int = 5
    variable_cost_pct: float = 15.0
    promo_payment: str = "promocao"
    anchor_category: str = "lente"
    target_category: str = "solar"
    conversion_pct: float = 20.0
    dead_stock_months: int = 8
    completeness_pct: float = 30.0
    outlier_ratio: float = 20.0
    cold_start_months: float = 4.0
    capture_pct: float = 60.0
    ramp_days: int = 180
    concentration_pct: float = 25.0
    service_category: str = "servico"
    reconciliation_tolerance: float = 1.0
