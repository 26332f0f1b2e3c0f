"""Plans that depend on data, dependency lists, and the session that owns named plans."""
