"""Column names, vocabularies and rules of the customer table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

LABEL = "Churn"
ID = "CustomerID"
IP_COLUMN = "LastLoginIP"

# ---------------------------------------------------------------------------
# Names, vocabularies and texts that results have to match.
# ---------------------------------------------------------------------------

INT_COLUMNS = [
    "Recency", "CustomerTenureDays", "FirstPurchaseDaysAgo", "PreferredDayOfWeek",
    "PreferredMonth", "ZeroPriceCount",
]
LONG_COLUMNS = [
    "Frequency", "PreferredHour", "UniqueProducts", "UniqueDescriptions", "UniqueCountries",
    "NegativeQuantityCount", "CancelledTransactions", "TotalTransactions", "UniqueInvoices",
    "Age", "SupportTicketsCount", "SatisfactionScore",
]

NUMERIC_COLUMNS = [
    "Recency", "Frequency", "MonetaryTotal", "MonetaryAvg", "MonetaryStd", "MonetaryMin",
    "MonetaryMax", "TotalQuantity", "AvgQuantityPerTransaction", "MinQuantity", "MaxQuantity",
    "CustomerTenureDays", "FirstPurchaseDaysAgo", "PreferredDayOfWeek", "PreferredHour",
    "PreferredMonth", "WeekendPurchaseRatio", "AvgDaysBetweenPurchases", "UniqueProducts",
    "UniqueDescriptions", "AvgProductsPerTransaction", "UniqueCountries",
    "NegativeQuantityCount", "ZeroPriceCount", "CancelledTransactions", "ReturnRatio",
    "TotalTransactions", "UniqueInvoices", "AvgLinesPerInvoice", "Age", "SupportTicketsCount",
    "SatisfactionScore",
]

ORDINAL_LEVELS = {
    "AgeCategory": ["Inconnu", "18-24", "25-34", "35-44", "45-54", "55-64", "65+"],
    "SpendingCategory": ["Low", "Medium", "High", "VIP"],
    "LoyaltyLevel": ["Jeune", "Établi", "Ancien"],
    "ChurnRiskCategory": ["Faible", "Moyen", "Élevé", "Critique"],
    "BasketSizeCategory": ["Petit", "Moyen", "Grand"],
    "PreferredTimeOfDay": ["Matin", "Midi", "Après-midi", "Soir"],
    "RFMSegment": ["Dormants", "Potentiels", "Fidèles", "Champions"],
}

ORDINAL_CODES = {
    "SpendingCategory": {"Low": 1, "Medium": 2, "High": 3, "VIP": 4},
    "ChurnRiskCategory": {"Faible": 1, "Moyen": 2, "Élevé": 3, "Critique": 4, "Eleve": 3},
    "BasketSizeCategory": {"Petit": 1, "Moyen": 2, "Grand": 3, "Inconnu": 0},
}

NOMINAL_COLUMNS = [
    "CustomerType", "FavoriteSeason", "Region", "WeekendPreference", "ProductDiversity",
    "Gender", "AccountStatus",
]
NOMINAL_COLUMNS_DROP_FIRST = [
    "CustomerType", "FavoriteSeason", "Region", "Gender", "AccountStatus",
]

DROPPED_COLUMNS = ["RegistrationDate", "NewsletterSubscribed", "CustomerID"]
DROPPED_COLUMNS_EXPLORE = ["CustomerID", "NewsletterSubscribed", "LastLoginIP", "RegistrationDate"]
DROPPED_CATEGORICALS = [
    "RFMSegment", "AgeCategory", "SpendingCategory", "CustomerType", "FavoriteSeason",
    "PreferredTimeOfDay", "Region", "LoyaltyLevel", "ChurnRiskCategory", "WeekendPreference",
    "BasketSizeCategory", "ProductDiversity", "Gender", "AccountStatus", "Country",
]

SENTINELS = {"SupportTicketsCount": [-1, 999], "SatisfactionScore": [-1, 99]}

OUTLIER_COLUMNS = ["MonetaryTotal", "TotalQuantity", "MonetaryMin", "MonetaryMax"]
BOX_COLUMNS = ["SupportTicketsCount", "SatisfactionScore"]
HISTOGRAM_COLUMNS = [
    "Recency", "Frequency", "MonetaryTotal", "MonetaryAvg", "TotalQuantity",
    "CustomerTenureDays", "Age",
]
VALUE_COUNT_COLUMNS = [
    "RFMSegment", "SpendingCategory", "CustomerType", "Region", "ChurnRiskCategory",
]

UNKNOWN = "Unknown"
TYPO, TYPO_FIX = "Inconn", "Inconnu"

PRIVATE_PREFIXES = ["10.", "172.16.", "192.168."]

RISK_THRESHOLDS = [0.2, 0.4, 0.6]
RISK_LEVELS = ["Low", "Medium", "High", "Critical"]
HIGH_RISK_LEVELS = ["High", "Critical"]

RISK_DESCRIPTIONS = {
    "service": [
        "Faible risque - Client fidèle",
        "Risque modéré - Surveillance recommandée",
        "Risque élevé - Actions préventives nécessaires",
        "Risque critique - Intervention urgente",
    ],
    "api": [
        "Faible risque — Client fidèle, aucune action urgente",
        "Risque modéré — Surveillance recommandée",
        "Risque élevé — Actions préventives nécessaires",
        "Risque critique — Intervention commerciale urgente",
    ],
}

RISK_RECOMMENDATIONS = {
    "service": [
        "Maintenir l'engagement, programme de fidélité",
        "Envoyer des offres personnalisées, suivre l'activité",
        "Contacter le client, offrir des réductions, enquête de satisfaction",
        "Action urgente: appel commercial, offre spéciale, résolution rapide",
    ],
    "api": [
        "Maintenir l'engagement : programme de fidélité, newsletter",
        "Envoyer des offres personnalisées et suivre l'activité",
        "Contacter le client, proposer une réduction, lancer une enquête satisfaction",
        "Action urgente : appel commercial prioritaire, offre exclusive, résolution rapide",
    ],
}

GAUGE_EDGES = [20, 40, 60, 80, 100]
GAUGE_COLORS = ["lightgreen", "yellowgreen", "orange", "salmon", "red"]

SEGMENT_ACTIONS = {
    "Clients à risque (Churn=1)": "Programme fidélisation, offres spéciales, contact proactif",
    "Champions": "Programme VIP, avant-premières produits",
    "Fidèles": "Récompenses de fidélité",
    "Potentiels": "Incentives pour augmenter les achats",
    "Dormants": "Campagnes de réactivation",
}
AT_RISK_SEGMENT = "Clients à risque (Churn=1)"


class RequestField(NamedTuple):
    """One field of a scoring request: kind, default and closed range."""

    name: str
    integral: bool
    default: float
    low: float | None
    high: float | None


REQUEST_FIELDS = [
    RequestField("Recency", True, 50, 0, None),
    RequestField("Frequency", True, 5, 0, None),
    RequestField("MonetaryTotal", False, 1000.0, 0, None),
    RequestField("TotalQuantity", True, 100, 0, None),
    RequestField("Age", True, 35, 18, 120),
    RequestField("SupportTicketsCount", True, 1, 0, None),
    RequestField("SatisfactionScore", True, 4, 1, 5),
    RequestField("ReturnRatio", False, 0.05, 0, 1),
    RequestField("AvgDaysBetweenPurchases", False, 30.0, 0, None),
    RequestField("CustomerTenureDays", True, 200, 0, None),
    RequestField("UniqueProducts", True, 20, 0, None),
]
# The data-entry form is stricter on two fields.
FORM_OVERRIDES = {"Frequency": {"low": 1}, "Age": {"high": 100}}

BATCH_REQUIRED_COLUMNS = ["Recency", "Frequency", "MonetaryTotal", "TotalQuantity", "Age"]

# One customer with typical values, keyed by raw column; the encoded profile of the
# sample (Régulier, Hiver, Semaine, Explorateur, M, Active, United Kingdom, class A) is
# kept as the raw categories that encode to it.
SAMPLE_NUMERIC = {
    "Recency": 50, "Frequency": 5, "MonetaryTotal": 1000.0, "MonetaryAvg": 200.0,
    "MonetaryStd": 50.0, "MonetaryMin": 10.0, "MonetaryMax": 500.0, "TotalQuantity": 100.0,
    "AvgQuantityPerTransaction": 10.0, "MinQuantity": 1.0, "MaxQuantity": 50.0,
    "CustomerTenureDays": 200, "FirstPurchaseDaysAgo": 180, "PreferredDayOfWeek": 3,
    "PreferredHour": 12, "PreferredMonth": 6, "WeekendPurchaseRatio": 0.3,
    "AvgDaysBetweenPurchases": 30.0, "UniqueProducts": 20, "UniqueDescriptions": 20,
    "AvgProductsPerTransaction": 5.0, "UniqueCountries": 1, "NegativeQuantityCount": 0,
    "ZeroPriceCount": 0, "CancelledTransactions": 0, "ReturnRatio": 0.05,
    "TotalTransactions": 5, "UniqueInvoices": 5, "AvgLinesPerInvoice": 10.0, "Age": 35,
    "SupportTicketsCount": 1, "SatisfactionScore": 4,
}
SAMPLE_ENCODED = {
    "IPClass_Class_A": 1,
    "AgeCategory": 2, "SpendingCategory": 2, "LoyaltyLevel": 2, "ChurnRiskCategory": 2,
    "BasketSizeCategory": 1, "PreferredTimeOfDay": 1, "RFMSegment": 2,
    "CustomerType_Régulier": 1, "FavoriteSeason_Hiver": 1, "WeekendPreference_Semaine": 1,
    "ProductDiversity_Explorateur": 1, "Gender_M": 1, "AccountStatus_Active": 1,
    "Country_United Kingdom": 1,
}
RISK_PROFILES = {
    "Client à faible risque": {
        "Frequency": 20, "MonetaryTotal": 5000.0, "Recency": 10,
        "SupportTicketsCount": 0, "ReturnRatio": 0.01},
    "Client à risque modéré": {
        "Frequency": 5, "MonetaryTotal": 1000.0, "Recency": 50,
        "SupportTicketsCount": 1, "ReturnRatio": 0.05},
    "Client à risque élevé": {
        "Frequency": 2, "MonetaryTotal": 200.0, "Recency": 150,
        "SupportTicketsCount": 3, "ReturnRatio": 0.15},
    "Client à risque critique": {
        "Frequency": 1, "MonetaryTotal": 50.0, "Recency": 300,
        "SupportTicketsCount": 5, "ReturnRatio": 0.3},
}

# ---------------------------------------------------------------------------


def _numeric_type(name: str) -> T.DataType:
    if name in INT_COLUMNS:
        return T.IntegerType()
    if name in LONG_COLUMNS:
        return T.LongType()
    return T.DoubleType()


STRING_COLUMNS = [
    *ORDINAL_LEVELS, *NOMINAL_COLUMNS, "Country", IP_COLUMN, "RegistrationDate",
    "NewsletterSubscribed",
]

RAW_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType())]
    + [T.StructField(c, _numeric_type(c)) for c in NUMERIC_COLUMNS]
    + [T.StructField(c, T.StringType()) for c in STRING_COLUMNS]
    + [T.StructField(LABEL, T.IntegerType())]
)


def numeric_fields(schema: T.StructType) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def string_fields(schema: T.StructType) -> list[str]:
    """Names of the text columns, in schema order."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
