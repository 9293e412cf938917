"""Writers: loose objects, packs, work trees."""
