"""Errors of the raster operators: bad data is RasterDataError, bad arguments are ValueError."""


class RasterDataError(Exception):
    pass
