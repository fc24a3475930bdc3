"""Record shapes of landed JSON and of stored tables, as DDL."""

from __future__ import annotations

_WEATHER = (
    "rh double, vis double, wc double, wspd double, feels_like double, uv_index double, temp double"
)

OBSERVATION = f"valid_time_gmt bigint, dewPt double, {_WEATHER}, pressure double"

FORECAST = (
    f"fcst_valid bigint, dewpt double, {_WEATHER}, icon_code int, phrase_12char string, "
    "phrase_22char string, wdir_cardinal string, gust double"
)

SCHEDULED_FLIGHT = (
    "carrierFsCode string, flightNumber string, departureAirportFsCode string, arrivalAirportFsCode string, "
    "departureTime timestamp_ntz, arrivalTime timestamp_ntz, departureTerminal string, arrivalTerminal string, "
    "flightEquipmentIataCode string, isCodeshare boolean, isWetlease boolean, codeshares array<string>, "
    "serviceClasses array<string>, serviceType string, stops int, trafficRestrictions array<string>, "
    "referenceCode string"
)

_INSTANT = "struct<dateUtc timestamp>"
FLIGHT_STATUS = (
    f"status string, operationalTimes struct<scheduledGateDeparture {_INSTANT}, "
    f"actualRunwayDeparture {_INSTANT}, actualRunwayArrival {_INSTANT}>"
)

AIRPORT = (
    "fs string, name string, city string, stateCode string, countryCode string, countryName string, "
    "latitude double, longitude double, timeZoneRegionName string, utcOffsetHours double, active boolean"
)

AIRLINE = "fs string, iata string, icao string, name string, phoneNumber string, active boolean"

EQUIPMENT = "iata string, name string, jet boolean, regional boolean, turboProp boolean, widebody boolean"

PREDICTION = "struct<overall string, models array<struct<model string, prediction string>>>"

HISTORY = (
    "depAirportFSCode string, depAirportName string, depAirportLong double, depAirportLat double, "
    "arrAirportFSCode string, arrAirportName string, arrAirportLong double, arrAirportLat double, "
    f"prediction {PREDICTION}, carrierFsCode string, flightNumber string, departureTime string, departureDate string, departureMonth date"
)
