"""Sources: files, intake of path lists, release feeds."""
