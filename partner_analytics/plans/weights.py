"""Weights of the composite scores."""

# Weights per area; the final score and the impact weigh operations differently.
COMMERCIAL = {"revenue": 0.80, "price_mark_up": 0.1, "exclusivity": 0.1}
MARKETING = {"facebook": 0.35, "door_sticker": 0.1, "voucher_cards": 0.1, "display": 0.1, "backlink": 0.35}
CONVERSION = {"reorder_rate": 0.2, "cr3": 0.8}
CONTENT = {"menucategories": 0.33, "products": 0.33, "products_without_description": 0.34}
OPS = {"packaging_quality": 0.10, "automation": 0.15, "cancellations": 0.15, "vendor_delay": 0.6}
OPS_FINAL = {
    "packaging_quality": 0.20, "automation": 0.2, "cancellations": 0.1, "processing_time": 0.1, "vendor_delay": 0.4,
}
AREAS = {"commercial": 0.2, "marketing": 0.2, "conversion": 0.1, "content": 0.1, "ops": 0.4}

# Fixed values: (area weight, KPI weight, score) of the money impact per KPI.
KPI_IMPACT = {
    "revenue": (0.3, 0.60), "price_mark_up": (0.3, 0.1), "exclusivity": (0.3, 0.15),
    "facebook": (0.2, 0.35), "backlink": (0.2, 0.35), "display": (0.2, 0.05), "door_sticker": (0.2, 0.05),
    "reorder_rate": (0.05, 0.20), "cr3": (0.05, 0.8),
    "menucategories": (0.05, 0.33), "products": (0.05, 0.33), "products_without_description": (0.05, 0.34),
    "packaging_quality": (0.4, 0.00), "automation": (0.4, 0.10), "cancellations": (0.4, 0.15),
    "processing_time": (0.4, 0.00), "vendor_delay": (0.0, 0.50), "closing_hours": (0.4, 0.10),
    "customer_complaints": (0.4, 0.15),
}
