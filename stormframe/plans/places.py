"""The points that place names of a basin's products stand for, (latitude, longitude) to about half a degree."""

from __future__ import annotations

AT: dict[str, tuple[float, float]] = {
    "hispaniola": (19.0, -71.0),
    "puerto rico": (18.2, -66.5),
    "lesser antilles": (15.5, -61.3),
    "greater antilles": (20.0, -76.0),
    "windward islands": (13.0, -61.2),
    "leeward islands": (17.5, -62.5),
    "southeastern bahamas": (22.0, -73.5),
    "central bahamas": (24.3, -76.0),
    "northwestern bahamas": (26.5, -78.0),
    "cabo verde": (16.0, -24.0),
    "cape verde": (16.0, -24.0),
    "yucatan": (20.0, -88.5),
    "yucatan peninsula": (20.0, -88.5),
    "bay of campeche": (19.5, -94.5),
    "jamaica": (18.1, -77.3),
    "cuba": (21.7, -79.5),
    "the bahamas": (24.3, -76.0),
    "nicaragua": (12.8, -84.0),
    "gulf of honduras": (16.5, -87.5),
    "straits of florida": (24.0, -81.0),
    "honduras": (15.0, -86.5),
    "florida": (27.8, -81.5),
    "northeastern gulf of america": (27.5, -85.5),
    "northwestern gulf of america": (27.0, -94.0),
    "northern gulf of america": (28.0, -89.0),
    "eastern gulf of america": (26.0, -84.5),
    "south-central gulf of america": (23.0, -90.0),
    "southwestern gulf of america": (21.5, -95.0),
    "central gulf of america": (25.0, -89.0),
    "gulf of america": (25.0, -90.0),
    "gulf of mexico": (25.0, -90.0),
    "central tropical atlantic": (11.0, -40.0),
    "eastern tropical atlantic": (12.0, -28.0),
    "western tropical atlantic": (20.0, -65.0),
    "central subtropical atlantic": (28.0, -50.0),
    "northwestern caribbean": (18.0, -85.0),
    "western caribbean": (16.0, -82.0),
    "central caribbean": (15.0, -75.0),
    "eastern caribbean": (15.0, -64.0),
    "caribbean": (15.0, -75.0),
}

EP: dict[str, tuple[float, float]] = {
    "gulf of tehuantepec": (16.0, -95.0),
    "gulf of california": (28.0, -112.0),
    "southern tip of the baja california": (22.9, -109.9),
    "southern tip of baja california": (22.9, -109.9),
    "baja california sur": (25.6, -111.9),
    "baja california": (29.0, -114.0),
    "revillagigedo islands": (18.8, -112.8),
    "revillagigedo": (18.8, -112.8),
    "socorro island": (18.8, -111.0),
    "clipperton island": (10.3, -109.2),
    "clipperton": (10.3, -109.2),
    "cabo corrientes": (20.4, -105.7),
    "gulf of papagayo": (10.7, -85.8),
    "gulf of fonseca": (13.3, -87.8),
    "gulf of panama": (8.1, -79.3),
    "azuero peninsula": (7.7, -80.6),
    "galapagos": (0.0, -90.5),
    "acapulco": (16.9, -99.9),
    "manzanillo": (19.1, -104.3),
    "salina cruz": (16.2, -95.2),
    "puerto vallarta": (20.7, -105.3),
    "zihuatanejo": (17.6, -101.6),
    "southwestern mexico": (17.0, -102.0),
    "jalisco": (20.5, -105.6),
    "colima": (19.0, -104.6),
    "michoacan": (17.8, -102.3),
    "guerrero": (17.0, -100.9),
    "oaxaca": (15.7, -97.3),
    "chiapas": (14.5, -92.6),
    "yucatan peninsula": (20.0, -88.5),
    "yucatan": (20.0, -88.5),
    "guatemala": (14.0, -92.2),
    "el salvador": (13.3, -89.4),
    "honduras": (15.0, -86.5),
    "nicaragua": (12.9, -85.1),
    "costa rica": (9.8, -85.0),
    "panama": (8.8, -80.0),
}

PLACES = {"AT": AT, "EP": EP}
