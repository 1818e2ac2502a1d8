"""Business definitions. Every job takes them as parameters; these are the defaults."""

# The results depend on these exact numbers and texts.
DELIVERED = "delivered"
BAD_MAX = 3
BUCKET_BOUNDS = (7, 14, 21, 30)
HIGH_RISK_PCT = 35
MIN_SELLER_ORDERS = 20
MIN_CATEGORY_ORDERS = 10
TOP_SELLERS = 30
LONG_DELIVERY_DAYS = 60
NEAR_SIMULTANEOUS_SECONDS = 3
DUPLICATES_SHOWN = 300
GAPS_SHOWN = 2000
SELLER_VOLUME_CUTS = (10, 15, 20, 30, 40, 50, 75, 100)

# Categories that occur in products but have no translation.
MISSING_TRANSLATIONS = [
    ("pc_gamer", "pc_gamer"),
    ("portateis_cozinha_e_preparadores_de_alimentos", "portable_kitchen_and_food_preparers"),
]

# English labels to replace, wrong label to right label.
LABEL_CORRECTIONS = {
    "fashio_female_clothing": "fashion_female_clothing",
    "home_confort": "home_comfort",
    "costruction_tools_garden": "construction_tools_garden",
    "costruction_tools_tools": "construction_tools_tools",
    "arts_and_craftmanship": "arts_and_craftsmanship",
    "security_and_services": "insurance_and_services",
    "cds_dvds_musicals": "cds_dvds_music",
    "cine_photo": "photography_and_video_equipment",
    "fixed_telephony": "landline_telephony",
}

# The two groups of labels whose product dimensions are compared.
TELEPHONY_LABELS = ("telephony", "fixed_telephony", "electronics")
KITCHEN_LABELS = ("la_cuisine", "food", "food_drink", "drinks", "housewares", "small_appliances")
