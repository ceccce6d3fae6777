"""Explicit schemas of the input files."""

from __future__ import annotations

# Column layouts of the input files.
VEHICLE = "VEIC string, LAT string, LON string, DTHR string, COD_LINHA string"

WEATHER = (
    "municipio string, codEstacao string, uf string, nomeEstacao string, latitude string, longitude string, "
    "datahora string, valorMedida string"
)

POINT = "struct<x:double,y:double>"

ALERTS = (
    "_id string, city string, comments string, confidence int, country string, id string, inscale boolean, "
    "isJamUnifiedAlert boolean, location string, magvar string, nComments int, nImages int, nThumbsUp int, "
    "pubMillis bigint, reliability int, reportBy string, reportDescription string, reportMood string, "
    "reportRating double, showFacebookPic string, speed double, street string, subtype string, type string, "
    "uuid string, wazeData string, roadType string, provider string, providerId string, nearBy string, "
    "imageId string, imageUrl string, reportByActiveGroupIcon string, reportByActiveGroupName string"
)

JAMS = (
    "_id string, city string, country string, delay int, endNode string, id string, length int, level int, "
    "line string, pubMillis bigint, roadType string, segments string, severity int, speed double, speedKMH double, "
    "street string, turnType string, type string, updateMillis bigint, uuid string, blockDescription string, "
    "blockExpiration bigint, blockStartTime bigint, blockType string, blockUpdate bigint, blockingAlertID string, "
    "blockingAlertUuid string, causeAlert string, startNode string"
)

GTFS = {
    "routes": "route_id string, agency_id string, route_short_name string, route_long_name string, route_desc string, "
    "route_type string, route_url string, route_color string, route_text_color string",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string, direction_id string, shape_id string",
    "stops": "stop_id string, stop_code string, stop_name string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, shape_dist_traveled double",
    "calendar": "service_id int, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, "
    "sunday int, start_date string, end_date string",
}

FEED_VEHICLE = "struct<id:string,lat:double,lon:double,line:string,time:string>"
