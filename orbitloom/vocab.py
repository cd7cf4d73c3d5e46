"""Word lists, lookup tables, thresholds and sentences.

Everything in this module is a fixed value that results depend on.  All tables
are literal and small (each under 200 rows), so they may be embedded in
expressions or broadcast without a size check.
"""

from __future__ import annotations

# --- fixed values: region gazetteer, list order decides (name, minx, miny, maxx, maxy)
REGIONS = (
    ("assam", 89.70, 24.10, 96.00, 28.00),
    ("guwahati", 91.60, 26.05, 91.90, 26.30),
    ("brahmaputra", 90.00, 25.80, 95.50, 27.80),
    ("kaziranga", 93.10, 26.55, 93.85, 26.75),
    ("mumbai", 72.75, 18.85, 73.05, 19.30),
    ("delhi", 76.80, 28.40, 77.40, 28.90),
    ("delhi ncr", 76.70, 28.20, 77.60, 29.00),
    ("kerala", 74.85, 8.28, 77.40, 12.80),
    ("wayanad", 75.90, 11.50, 76.40, 11.95),
    ("sundarbans", 88.00, 21.50, 89.90, 22.50),
    ("ladakh", 75.50, 32.00, 79.50, 36.00),
    ("thar desert", 69.50, 24.50, 76.00, 30.00),
    ("rajasthan", 69.50, 23.00, 78.20, 30.20),
    ("bengaluru", 77.45, 12.80, 77.80, 13.15),
    ("bangalore", 77.45, 12.80, 77.80, 13.15),
    ("chennai", 80.10, 12.85, 80.35, 13.25),
    ("kolkata", 88.20, 22.40, 88.50, 22.70),
    ("hyderabad", 78.30, 17.25, 78.65, 17.55),
    ("odisha", 81.30, 17.80, 87.50, 22.60),
    ("uttarakhand", 77.60, 28.70, 81.10, 31.50),
)

# --- fixed values: month spellings
MONTHS = (
    ("january", 1), ("jan", 1), ("february", 2), ("feb", 2), ("march", 3), ("mar", 3),
    ("april", 4), ("apr", 4), ("may", 5), ("june", 6), ("jun", 6), ("july", 7), ("jul", 7),
    ("august", 8), ("aug", 8), ("september", 9), ("sept", 9), ("sep", 9), ("october", 10),
    ("oct", 10), ("november", 11), ("nov", 11), ("december", 12), ("dec", 12),
)

# --- fixed values: words that mark a change question
CHANGE_WORDS = (
    "change", "changed", "difference", "different", "before and after", "evolution",
    "flood", "flooding", "submerged", "inundation", "damage", "destroyed",
    "deforestation", "clearing", "tree loss", "burned", "wildfire", "fire scar",
    "urban growth", "construction", "expansion", "built up", "shrinking", "rebuilt",
    "drought", "dried up", "coastal erosion", "landslide",
)

# --- fixed values: intents in tie-break order (name, weight, keywords, regex patterns)
INTENTS = (
    ("PROVENANCE", 1.0,
     ("source", "provenance", "trace", "origin", "where did", "came from", "processing lineage", "audit"),
     (r"where\s+did\s+this", r"source\s+of", r"how\s+was\s+this", r"provenance\s+of")),
    ("CHANGE_ANALYSIS", 0.9,
     CHANGE_WORDS,
     (r"what\s+(has\s+)?changed", r"any\s+changes?", r"detect\s+change", r"before\s+and\s+after",
      r"how\s+has\s+.+\s+changed", r"damage\s+in", r"flood\s+(in|around)", r"expansion\s+in")),
    ("IMAGE_SIMILARITY", 0.85,
     ("similar", "like this", "looks like", "resembles", "matching", "find more", "more like", "same kind"),
     (r"similar\s+(to|locations?|sites?|areas?|images?)", r"find\s+(more\s+)?like", r"looks?\s+like\s+this")),
    ("VQA", 0.8,
     ("what is", "describe", "identify", "visible", "recognize", "land use", "land cover", "what features"),
     (r"what\s+is\s+(visible|shown|this|in\s+this)", r"describe\s+(this|the)", r"what\s+can\s+you\s+see",
      r"identify\s+the")),
    ("SEMANTIC_SEARCH", 0.7,
     ("find", "search", "show", "locate", "where", "look for", "discover", "airport", "port", "solar farm",
      "river", "forest", "buildings"),
     (r"find\s+.+", r"search\s+for", r"show\s+me", r"where\s+(are|is|can)", r"locate\s+")),
)
DEFAULT_INTENT = "SEMANTIC_SEARCH"
CONTEXT_BOOST = 1.3
CONTEXT_BOOSTED = ("CHANGE_ANALYSIS", "IMAGE_SIMILARITY", "VQA")
CLASSIFIER_CONFIDENCE = 0.92
DEFAULT_YEAR = 2024

# --- fixed values: rerank domains in priority order
# (name, query keywords, confirming scene names, contradicting scene names, confirmation text, contradiction text)
DOMAINS = (
    ("mangrove",
     ("mangrove", "wetland", "wetlands", "tidal", "estuary", "sundarbans", "marsh", "swamp", "delta"),
     ("SUNDARBANS_MANGROVE",),
     ("BHADLA_SOLAR_PARK", "URBAN_INDUSTRIAL_HUB"),
     "Confirmed coastal mangrove wetland ecosystem with dense tidal creek drainage and saline vegetative foliage (NDVI > 0.40, NDWI > 0.20).",
     "Non-wetland landscape: Lacks tidal creek drainage and mangrove vegetation."),
    ("industrial",
     ("industrial", "warehouse", "warehouses", "factory", "factories", "commercial", "logistics", "storage", "tanks", "depot"),
     ("URBAN_INDUSTRIAL_HUB", "MUMBAI_PORT_COAST"),
     ("BHADLA_SOLAR_PARK", "FOREST_WATERSHED", "SUNDARBANS_MANGROVE"),
     "Confirmed large-scale industrial warehouse roofs, metal structural facilities, and logistical loading zones (NDBI > 0.12).",
     "Non-industrial land cover."),
    ("transportation",
     ("road", "roads", "highway", "highways", "transportation", "runway", "runways", "airport", "tarmac", "interchange", "asphalt"),
     ("URBAN_INDUSTRIAL_HUB", "MUMBAI_PORT_COAST", "GUWAHATI"),
     ("FOREST_WATERSHED", "SUNDARBANS_MANGROVE"),
     "Confirmed linear transportation corridor, asphalt roadway network, and paved transit infrastructure.",
     "Lacks engineered transportation or asphalt roadway corridors."),
    ("solar",
     ("solar", "panels", "photovoltaic", "solar park", "desert grid", "renewable", "solar array", "bhadla"),
     ("BHADLA_SOLAR_PARK",),
     ("FOREST_WATERSHED", "SUNDARBANS_MANGROVE", "COASTAL_AGRICULTURE"),
     "Confirmed high-density geometric photovoltaic solar panel arrays aligned over arid desert substrate.",
     "Non-photovoltaic terrain."),
    ("port",
     ("port", "harbor", "shipping", "ships", "dock", "pier", "coastal port", "mumbai"),
     ("MUMBAI_PORT_COAST",),
     ("BHADLA_SOLAR_PARK", "FOREST_WATERSHED"),
     "Confirmed deepwater marine terminal, cargo vessel berthing piers, and port logistical infrastructure.",
     "Inland land cover without coastal port facilities."),
    ("agriculture",
     ("agriculture", "agricultural", "crop", "crops", "farmland", "farm", "field", "fields", "pasture", "orchard", "cultivated", "planting", "paddy"),
     ("COASTAL_AGRICULTURE", "AGRICULTURE", "FARMLAND", "GUWAHATI"),
     ("BHADLA_SOLAR_PARK", "URBAN_INDUSTRIAL_HUB", "MUMBAI_PORT_COAST"),
     "Confirmed active agricultural cropland parcel with high vegetative chlorophyll response (NDVI > 0.35) and delineated field boundaries.",
     "Suppressed false match: Arid terrain or concrete built-up surface lacks agricultural vegetation."),
    ("urban",
     ("urban", "building", "buildings", "house", "residential", "roof", "roofs", "city", "structure", "structures", "settlement", "downtown", "metropolitan"),
     ("URBAN_INDUSTRIAL_HUB", "MUMBAI_PORT_COAST", "GUWAHATI"),
     ("BHADLA_SOLAR_PARK", "FOREST_WATERSHED", "SUNDARBANS_MANGROVE"),
     "Confirmed high-density built-up infrastructure, commercial rooftops, and impervious road grid network (NDBI > 0.10).",
     "Suppressed false match: Rural vegetation or open water canopy lacks urban built-up density."),
    ("forest",
     ("forest", "trees", "woodland", "canopy", "vegetation", "dense", "reserve", "hills", "green", "jungle"),
     ("FOREST_WATERSHED", "SUNDARBANS_MANGROVE", "BRAHMAPUTRA"),
     ("BHADLA_SOLAR_PARK", "URBAN_INDUSTRIAL_HUB"),
     "Confirmed contiguous closed forest canopy, high near-infrared reflectance, and natural ecological foliage (NDVI > 0.48).",
     "Suppressed false match: Arid terrain or dense concrete built-up surface."),
    ("water",
     ("water", "river", "lake", "ocean", "sea", "marine", "coast", "coastal", "stream", "channel", "sediment", "bay", "flood", "flooding", "meander", "beach", "waves"),
     ("BRAHMAPUTRA", "SUNDARBANS_MANGROVE", "MUMBAI_PORT_COAST"),
     ("BHADLA_SOLAR_PARK", "URBAN_INDUSTRIAL_HUB"),
     "Confirmed open water body, riverine drainage channel, and coastal sediment plume interface (NDWI > 0.15).",
     "Suppressed false match: Lacks persistent surface water absorption spectral signature."),
)
UNVERIFIED_TEXT = "Visual embedding alignment verified with %s%% confidence against target query criteria."

# --- fixed values: prompt templates, '%s' is the query text
PROMPT_TEMPLATES = (
    "%s",
    "a satellite photo of %s",
    "satellite imagery showing %s",
    "aerial view of %s",
    "remote sensing capture of %s",
)

# --- fixed values: sensors by file-name pattern, first match wins (matched on the upper-cased name)
SENSOR_PATTERNS = (
    ("Sentinel-2", r"S2[AB]?_|SENTINEL.?2|^S2_"),
    ("Sentinel-1", r"S1[AB]?_|SENTINEL.?1"),
    ("Landsat-8", r"LC08|LANDSAT.?8|L8_"),
    ("Landsat-9", r"LC09|LANDSAT.?9|L9_"),
    ("MODIS", r"MOD\d{2}|MYD\d{2}"),
    ("PlanetScope", r"PLANET"),
)
RASTER_SUFFIXES = (".tif", ".tiff", ".geotiff")
TILE_SIZE = 256
TILE_OVERLAP = 32
PROCESSING_VERSION = "0.1.0"
REVIEW_DECISIONS = ("confirmed", "rejected", "uncertain")

# --- fixed values: co-location distance in degrees (strict) and the change share that keeps a walk going
COLOCATION_DEGREES = 0.05
SUPPORTED_CHANGE_PCT = 2.0

# --- fixed values: confidence weights
CONFIDENCE_WEIGHTS = {
    "structural": 0.35, "spectral": 0.25, "registration": 0.15,
    "persistence": 0.15, "seasonal": -0.10, "cloud": -0.10,
}

# --- fixed values: change driver sentences ('%s' are 2-decimal deltas)
DRIVER_TEXT = {
    "water_inundation_or_flood": "Flood/water inundation verified by strong NDWI increase (+%s) and vegetation decline (%s).",
    "vegetation_loss_or_clearing": "Vegetation canopy loss/clearing verified by significant NDVI decline (%s).",
    "vegetation_greening": "Vegetation growth/greening verified by significant NDVI increase (+%s).",
    "urban_construction_or_expansion": "Built-up / infrastructure expansion verified by high built-up index (+%s).",
    "illumination_or_texture_shift": "Low spectral index shift across changed region; indicates possible illumination or shadow variation.",
    "unclassified_structural": "Structural change detected.",
    "none": "No significant change pixels detected.",
}

# --- fixed values: caption templates by land cover, in listing order
CAPTION_TEMPLATES = (
    ("dense_vegetation", (
        "dense green vegetation and forest canopy covering the landscape",
        "thick tree cover with high vegetation density in a forested area",
        "lush green forest with continuous canopy visible from satellite",
        "dense tropical or subtropical forest with dark green foliage",
        "heavily vegetated terrain showing mature tree growth",
        "satellite view of dense forest cover with high NDVI values")),
    ("sparse_vegetation", (
        "sparse vegetation with patches of greenery and exposed ground",
        "scattered trees and shrubs across semi-arid terrain",
        "grassland with moderate vegetation density",
        "open woodland with sparse tree coverage",
        "mixed terrain with scattered vegetation patches",
        "transitional zone between vegetated and barren land")),
    ("water", (
        "water body visible as a dark blue region in the satellite image",
        "river flowing through the landscape with surrounding riverbanks",
        "lake or reservoir with calm water surface reflecting low near-infrared",
        "aquatic feature surrounded by riparian vegetation",
        "waterway or canal cutting through the terrain",
        "large water body with distinctive dark spectral signature")),
    ("built_up", (
        "urban area with buildings and concrete infrastructure visible",
        "dense urban settlement with closely packed structures",
        "developed area showing roads buildings and impervious surfaces",
        "city or town center with high density of built-up structures",
        "residential neighborhood with rows of houses and street patterns",
        "industrial or commercial zone with large roof surfaces",
        "urban infrastructure including roads and parking areas")),
    ("bare_soil", (
        "bare soil or exposed earth with no vegetation cover",
        "dry barren land with exposed ground surface",
        "cleared or fallow land without active vegetation",
        "arid terrain with minimal ground cover",
        "excavated or construction site showing bare earth",
        "desert-like conditions with sandy or rocky surface")),
    ("agricultural", (
        "agricultural fields with organized crop patterns",
        "farmland showing regular planting rows visible from above",
        "cultivated area with active crop growth",
        "irrigated agricultural plots with green vegetation",
        "crop fields showing different stages of growth",
        "agricultural landscape with field boundaries and farm roads")),
    ("mixed", (
        "mixed land use area combining urban and natural features",
        "transitional landscape with both vegetation and built structures",
        "suburban area with buildings interspersed with green spaces",
        "peri-urban zone showing rural to urban transition")),
    ("cloud_or_haze", (
        "satellite image partially obscured by cloud cover",
        "hazy atmospheric conditions affecting image clarity",
        "cloud shadows visible across the terrain below")),
)
# classes that never serve as hard negatives
NOT_NEGATIVE = ("mixed", "cloud_or_haze")

# --- fixed values: season sentences
SEASONS = (
    ("winter", "during the dry winter season with lower vegetation activity"),
    ("pre_monsoon", "in the pre-monsoon season showing early green growth"),
    ("monsoon", "during the monsoon season with peak vegetation and water levels"),
    ("post_monsoon", "in the post-monsoon period with receding water and drying crops"),
)

# --- fixed values: curated queries by land cover
CURATED_QUERIES = (
    ("dense_vegetation", ("dense tropical forest canopy", "mangrove forest along coastline", "deciduous forest in winter")),
    ("sparse_vegetation", ("grasslands with sparse tree cover", "scattered shrubs across semi-arid terrain", "savanna with dispersed vegetation")),
    ("water", ("river flowing through a valley", "lake surrounded by vegetation", "wetland with marshy vegetation")),
    ("built_up", ("urban area with dense buildings", "residential neighborhood from satellite view", "roads and highways cutting through urban landscape")),
    ("bare_soil", ("construction site with bare earth and equipment", "desert landscape with sand dunes", "rocky terrain with sparse vegetation")),
    ("agricultural", ("agricultural cropland with irrigation", "rice paddy fields with water", "hilly terrain with terraced farming")),
)
CURATED_DEFAULT = ("urban area with dense buildings", "city center with high-rise structures", "residential neighborhood from satellite view")

# --- fixed values: captions by scene class
CLASS_CAPTIONS = (
    ("AnnualCrop", (
        "satellite view of agricultural crop fields with distinct parcel boundaries",
        "overhead optical imagery of cultivated farmland and agricultural plots",
        "remote sensing view of green cropland with irrigation and farm boundaries",
        "aerial view of rectangular agricultural fields and planted crops",
        "patchwork of fertile farm fields and agricultural land from orbit")),
    ("Forest", (
        "dense forest canopy and continuous green woodland from satellite",
        "remote sensing view of deep green coniferous and deciduous forest",
        "overhead view of natural forest reserve and dense tree cover",
        "satellite capture of undisturbed woodland and forested hills",
        "aerial imagery showing dense canopy of temperate forest vegetation")),
    ("HerbaceousVegetation", (
        "open grassland meadow and natural herbaceous vegetation",
        "satellite imagery of rural grazing prairie and wild grasslands",
        "remote sensing view of open field with low herbaceous cover",
        "overhead view of natural savannah and wild grassland landscape")),
    ("Highway", (
        "asphalt highway and multi-lane transportation corridor through landscape",
        "satellite imagery showing paved road network and highway interchange",
        "overhead view of primary highway and rural road intersection",
        "remote sensing image of transportation infrastructure and roadway")),
    ("Industrial", (
        "industrial manufacturing park with large warehouse buildings and storage",
        "satellite view of commercial logistics facility and industrial roofs",
        "overhead optical view of industrial complex with metal roofs and loading bays",
        "remote sensing capture of factory infrastructure and commercial buildings")),
    ("Pasture", (
        "green pasture land and agricultural grazing fields from orbit",
        "satellite imagery of rural livestock pasture and open grassland",
        "overhead view of agricultural pasture and grass fields",
        "remote sensing photo of open rural pasture and farm paddock")),
    ("PermanentCrop", (
        "permanent orchards and vineyard agricultural plantation rows",
        "satellite view of geometric fruit tree orchard and permanent crops",
        "remote sensing image of structured crop plantation and agricultural rows",
        "overhead view of permanent agricultural groves and vineyard rows")),
    ("Residential", (
        "residential neighborhood with houses, suburban streets, and rooftops",
        "satellite imagery of suburban housing development and urban settlement",
        "overhead view of residential buildings, private yards, and access roads",
        "remote sensing view of dense residential living zone and street grid")),
    ("River", (
        "meandering river channel cutting through rural landscape and floodplain",
        "satellite view of winding freshwater river and surrounding riparian banks",
        "remote sensing imagery of natural river watercourse with sandbars",
        "overhead view of braided river channel with water sediment flow")),
    ("SeaLake", (
        "open coastal sea water with sediment runoff and deep blue water",
        "satellite imagery of freshwater lake with coastal shoreline",
        "remote sensing view of calm marine coastal waters and turquoise sediment plumes",
        "overhead view of natural lake water body and shoreline transition")),
)

# --- fixed values: synthetic near-infrared groups by scene class
NIR_VEGETATION = ("Forest", "HerbaceousVegetation", "PermanentCrop", "Pasture", "AnnualCrop")
NIR_WATER = ("SeaLake", "River")
NIR_PAVED = ("Industrial", "Highway")

# --- fixed values: scene keyword -> query categories
SCENE_CATEGORIES = (
    ("AGRICULTURE", ("agriculture",)),
    ("URBAN", ("urban_residential", "urban_commercial", "transportation_aviation")),
    ("INDUSTRIAL", ("industrial_logistics",)),
    ("FOREST", ("forestry_canopy",)),
    ("MANGROVE", ("mangroves_wetlands", "forestry_canopy")),
    ("BRAHMAPUTRA", ("hydrology_rivers", "change_disaster")),
    ("BHADLA", ("solar_energy",)),
    ("MUMBAI", ("maritime_ports", "transportation_aviation", "urban_commercial")),
    ("GUWAHATI", ("urban_residential", "agriculture", "hydrology_rivers")),
    ("COASTAL", ("maritime_ports", "mangroves_wetlands", "agriculture")),
    ("WATERSHED", ("forestry_canopy", "hydrology_rivers")),
)
DEFAULT_CATEGORIES = ("agriculture", "urban_residential", "hydrology_rivers")

# --- fixed values: query taxonomy by category
QUERY_TAXONOMY = (
    ("agriculture", (
        "agricultural fields with visible crop parcel boundaries",
        "cultivated farmland and green agricultural plots from satellite",
        "geometric crop fields with irrigation channels",
        "overhead view of rice paddy fields and standing water",
        "patchwork of fertile agricultural crops and farm parcels",
        "orchards and vineyard plantation rows viewed from orbit",
        "rural pasture land and livestock grazing fields",
        "terrace farming on hillsides with green vegetation",
        "harvested farmland with bare soil and field boundaries",
        "pivot irrigation agricultural circles in rural landscape",
        "fertile cropland parcels with high chlorophyll reflectance",
        "vegetable crop farming and agricultural greenhouse structures",
        "rural agricultural landscape with farm roads and drainage ditches",
        "monoculture crop fields during peak growing season",
        "agricultural plots transition from vegetative growth to harvest")),
    ("urban_residential", (
        "dense urban residential neighborhood with houses and streets",
        "suburban housing development with private rooftops and gardens",
        "high-density residential settlement and narrow alleyways",
        "city residential block with apartment buildings and parking",
        "overhead optical view of urban sprawl and suburban expansion",
        "planned residential community with cul-de-sacs and asphalt roads",
        "residential rooftops with varying color tiles and building clusters",
        "multi-story residential apartments in metropolitan area",
        "satellite view of urban dwelling zones and neighborhood street grid",
        "mixed urban residential and neighborhood commercial shops")),
    ("urban_commercial", (
        "city center with high-rise skyscrapers and commercial towers",
        "downtown commercial district with dense concrete buildings",
        "metropolitan skyline and commercial office complexes",
        "urban core with multi-story buildings and street intersections",
        "central business district with high impervious surface coverage",
        "commercial plaza and urban retail buildings from orbit",
        "dense downtown street grid and concrete infrastructure")),
    ("industrial_logistics", (
        "industrial manufacturing park with large warehouse buildings",
        "logistics distribution center with loading docks and trucks",
        "factory complex with metal roofs and industrial machinery",
        "chemical storage facility with round oil tanks and pipelines",
        "commercial freight warehouse park near transport corridors",
        "heavy industrial zone with manufacturing plants and smokestacks",
        "storage yards and logistics shipping containers near railway",
        "industrial processing facility with concrete yards and warehouses")),
    ("transportation_aviation", (
        "airport runways, taxiways, and airplane tarmac from satellite",
        "asphalt highway interchange and multi-lane transportation corridor",
        "bridge crossing wide river carrying roadway and rail traffic",
        "railway junction and freight train classification yard",
        "paved arterial road cutting through mixed urban landscape",
        "multi-level highway flyover and traffic interchange",
        "commercial aviation airport with terminal buildings and runways",
        "highway toll plaza and multi-lane asphalt expressway")),
    ("forestry_canopy", (
        "dense tropical forest canopy with continuous tree cover",
        "natural woodland reserve and deep green temperate forest",
        "coniferous forest on mountainous terrain from space",
        "dense tree foliage and intact ecological forest reserve",
        "continuous woodland canopy on hills with high chlorophyll response",
        "deciduous forest in full summer foliage viewed from orbit",
        "lush tropical rainforest with dense multi-layered tree canopy",
        "protected ecological forest buffer along river valley")),
    ("mangroves_wetlands", (
        "coastal mangrove wetland ecosystem with dense tidal creeks",
        "saline tidal marsh and braided mangrove forest channels",
        "estuary wetland with mangrove vegetation and mudflats",
        "coastal swamp forest intersecting with shallow marine waters",
        "tidal delta with mangrove buffer and sediment-rich water",
        "protected mangrove conservation reserve along coastline")),
    ("hydrology_rivers", (
        "meandering river channel cutting through valley and floodplain",
        "braided river system with sandbars and sediment flow",
        "freshwater river meeting natural lake with riparian banks",
        "river delta with branching watercourses and sediment plumes",
        "flooded river overflow basin during high water season",
        "deep blue freshwater lake surrounded by natural vegetation",
        "artificial water reservoir behind hydroelectric dam",
        "inland canal watercourse with regulated water flow")),
    ("maritime_ports", (
        "deepwater marine port with cargo vessel berthing piers",
        "shipping terminal with container cranes and moored cargo ships",
        "coastal harbor with breakwaters, docks, and maritime traffic",
        "ocean vessel shipping lane approaching coastal port terminal",
        "marine shipyard with dry docks and vessel berths",
        "coastal port facilities with container storage and logistics")),
    ("solar_energy", (
        "high-density photovoltaic solar panel arrays in desert",
        "utility-scale solar park with aligned blue photovoltaic panels",
        "solar energy power station over arid ground substrate",
        "grid-aligned solar photovoltaic modules in desert solar park",
        "large-scale renewable solar farm with transformer stations")),
    ("change_disaster", (
        "severe river flood inundation over surrounding agricultural plains",
        "urban encroachment and new construction over former cropland",
        "wildfire burn scar on forested hillside and charred ground",
        "deforested land clearing showing bare earth and logging tracks",
        "coastal shoreline erosion and changing beach sediment line",
        "drought-affected reservoir with receding water level and dry bed")),
)

# --- fixed values: spectral phrase, (above this value, words); None: otherwise
PHRASE_START, PHRASE_JOIN = "terrain with ", " and "
VEGETATION_PHRASES = (
    (0.5, "high vegetation density"), (0.3, "moderate vegetation cover"), (0.15, "sparse vegetation"), (None, "minimal vegetation"),
)
WATER_PHRASES = ((0.15, "significant water presence"), (0.0, "traces of moisture or water"))
BRIGHT_PHRASE = (0.6, "high reflectance from bright surfaces")
DARK_PHRASE = (0.15, "dark surface features")

# --- fixed values: place clauses cut from a query text, around the place name
PLACE_CLAUSE = (r"(?i)\b(?:in|around|near|across)\s+", r"\b")
PLACE_ALONE = (r"(?i)\b", r"\b")
