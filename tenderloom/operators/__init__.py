"""Frame operators: the calendar cube, rankings, paging, ids, upserts."""
