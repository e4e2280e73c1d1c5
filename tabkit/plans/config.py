"""The two worked configurations: closed sales and listings.

All lists are fixed values: column names of the exports, in the order of the exports or by topic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The columns one page of closed sales is projected to.
SOLD_EXPORT_COLUMNS = """
BuyerAgentAOR ListAgentAOR Flooring ViewYN WaterfrontYN BasementYN PoolPrivateYN OriginalListPrice
ListingKey CloseDate ClosePrice ListAgentFirstName ListAgentLastName Latitude Longitude UnparsedAddress
PropertyType LivingArea ListPrice DaysOnMarket ListOfficeName BuyerOfficeName CoListOfficeName
ListAgentFullName CoListAgentFirstName CoListAgentLastName BuyerAgentMlsId BuyerAgentFirstName
BuyerAgentLastName FireplacesTotal AssociationFeeFrequency AboveGradeFinishedArea ListingKeyNumeric
MLSAreaMajor TaxAnnualAmount CountyOrParish MlsStatus ElementarySchool AttachedGarageYN ParkingTotal
BuilderName PropertySubType LotSizeAcres SubdivisionName BuyerOfficeAOR YearBuilt StreetNumberNumeric
ListingId BathroomsTotalInteger City TaxYear BuildingAreaTotal BedroomsTotal ContractStatusChangeDate
ElementarySchoolDistrict CoBuyerAgentFirstName PurchaseContractDate ListingContractDate
BelowGradeFinishedArea BusinessType StateOrProvince CoveredSpaces MiddleOrJuniorSchool FireplaceYN Stories
HighSchool Levels LotSizeDimensions LotSizeArea MainLevelBedrooms NewConstructionYN GarageSpaces
HighSchoolDistrict PostalCode AssociationFee LotSizeSquareFeet MiddleOrJuniorSchoolDistrict
OriginatingSystemName OriginatingSystemSubName
""".split()

# Sales columns that listing pages do not carry.
_NOT_IN_LISTINGS = """
BuyerAgentAOR ListAgentAOR Flooring ViewYN WaterfrontYN BasementYN PoolPrivateYN
OriginatingSystemName OriginatingSystemSubName
""".split()

LISTED_EXPORT_COLUMNS = [c for c in SOLD_EXPORT_COLUMNS if c not in _NOT_IN_LISTINGS]

DATE_COLUMNS = ["CloseDate", "PurchaseContractDate", "ListingContractDate"]
MOMENT_COLUMNS = ["ContractStatusChangeDate"]

# Columns read as numbers.
NUMERIC_COLUMNS = """
ClosePrice ListPrice OriginalListPrice LivingArea LotSizeAcres LotSizeArea LotSizeSquareFeet
BedroomsTotal BathroomsTotalInteger DaysOnMarket YearBuilt
AboveGradeFinishedArea BelowGradeFinishedArea BuildingAreaTotal
GarageSpaces CoveredSpaces ParkingTotal FireplacesTotal
AssociationFee Latitude Longitude Stories MainLevelBedrooms
""".split()

# Columns never dropped for missing values.
ESSENTIAL_COLUMNS = """
ClosePrice ListPrice OriginalListPrice LivingArea LotSizeAcres BedroomsTotal BathroomsTotalInteger
DaysOnMarket YearBuilt CloseDate PurchaseContractDate ListingContractDate PropertyType PropertySubType
MlsStatus CountyOrParish City PostalCode StateOrProvince Latitude Longitude
""".split()

# Columns without analytical use - persons, associations, schools, taxes, system fields.
DROPPED_COLUMNS = """
ListAgentEmail ListAgentFirstName ListAgentLastName CoListAgentFirstName CoListAgentLastName
BuyerAgentFirstName BuyerAgentLastName CoBuyerAgentFirstName
ListAgentAOR BuyerAgentAOR BuyerOfficeAOR
ElementarySchool ElementarySchoolDistrict MiddleOrJuniorSchool MiddleOrJuniorSchoolDistrict
HighSchool HighSchoolDistrict
TaxYear TaxAnnualAmount
OriginatingSystemName OriginatingSystemSubName
LotSizeDimensions BusinessType
""".split()

# Further columns dropped from listings.
LISTED_DROPPED_COLUMNS = [*DROPPED_COLUMNS, "ListAgentFullName", "BuyerAgencyCompensation", "BuyerAgencyCompensationType"]

PROFILE_FIELDS = [
    "ListPrice", "OriginalListPrice", "LivingArea", "LotSizeAcres",
    "BedroomsTotal", "BathroomsTotalInteger", "DaysOnMarket", "YearBuilt",
]

# Columns dropped by the quick variants.
QUICK_SOLD_DROPPED = """
WaterfrontYN latfilled lonfilled BuyerAgencyCompensationType BuyerAgencyCompensation
OriginatingSystemSubName BusinessType MiddleOrJuniorSchoolDistrict TaxYear FireplacesTotal
TaxAnnualAmount AboveGradeFinishedArea
""".split()
QUICK_LISTED_DROPPED = """
BuyerAgencyCompensationType BuyerAgencyCompensation BusinessType TaxYear AboveGradeFinishedArea
MiddleOrJuniorSchoolDistrict
""".split()

# Columns whose missing values the quick variants report.
QUICK_SOLD_CRITICAL = """
ClosePrice ListPrice OriginalListPrice LivingArea DaysOnMarket PropertyType CloseDate City PostalCode
BedroomsTotal BathroomsTotalInteger
""".split()
QUICK_LISTED_CRITICAL = """
ListPrice OriginalListPrice LivingArea DaysOnMarket PropertyType ListingContractDate City PostalCode
BedroomsTotal BathroomsTotalInteger MlsStatus
""".split()


@dataclass(frozen=True)
class QuickConfig:
    """What the quick variant does differently from the full pipeline."""

    dropped: list[str]
    strict_drop: bool
    critical: list[str]
    price_per_area: str
    year: str
    month: str
    yrmo: str = "YrMo"
    ratio: str = "PriceRatio"


@dataclass(frozen=True)
class PipelineConfig:
    name: str
    price: str
    event_date: str  # decides the month of the rate and the time columns
    time_prefix: str
    count_name: str
    median_price_name: str
    dropped: list[str]
    profile_fields: list[str]
    export_columns: list[str]
    ratio_guard: float
    ratio_bounds: tuple[float, float] | None
    closed_ratio: bool  # a close-to-original ratio of its own, with the list price as fallback
    status: str | None  # status an exported row must have
    quick: QuickConfig
    category: str = "PropertyType"
    category_value: str = "Residential"
    segment: str = "CountyOrParish"
    iqr_factor: float = 1.5
    missing_threshold: float = 90.0
    essential: list[str] = field(default_factory=lambda: list(ESSENTIAL_COLUMNS))

    @property
    def outlier_fields(self) -> list[str]:
        return [self.price, "LivingArea", "DaysOnMarket"]

    @property
    def outlier_flags(self) -> list[str]:
        return [f"{f}_outlier_flag" for f in self.outlier_fields]

    @property
    def key_fields(self) -> list[str]:
        return [self.price, "price_per_sqft", "DaysOnMarket", "mortgage_rate_30yr"]


SOLD = PipelineConfig(
    name="sold",
    price="ClosePrice",
    event_date="CloseDate",
    time_prefix="close",
    count_name="sale_count",
    median_price_name="median_close_price",
    dropped=DROPPED_COLUMNS,
    profile_fields=["ClosePrice", *PROFILE_FIELDS],
    export_columns=SOLD_EXPORT_COLUMNS,
    ratio_guard=1000.0,
    ratio_bounds=(0.5, 1.5),
    closed_ratio=False,
    status="Closed",
    quick=QuickConfig(QUICK_SOLD_DROPPED, True, QUICK_SOLD_CRITICAL, "PricePerSqFt", "CloseYear", "CloseMonth"),
)

LISTED = PipelineConfig(
    name="listed",
    price="ListPrice",
    event_date="ListingContractDate",
    time_prefix="listing",
    count_name="listing_count",
    median_price_name="median_list_price",
    dropped=LISTED_DROPPED_COLUMNS,
    profile_fields=PROFILE_FIELDS,
    export_columns=LISTED_EXPORT_COLUMNS,
    ratio_guard=0.0,
    ratio_bounds=None,
    closed_ratio=True,
    status=None,
    quick=QuickConfig(QUICK_LISTED_DROPPED, False, QUICK_LISTED_CRITICAL, "ListPricePerSqFt", "ListYear", "ListMonth"),
)
